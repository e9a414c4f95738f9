"""Running text of each language, from the opening articles of the Universal Declaration of Human Rights (public text) and a few
plain sentences: what the character models start from before they see a table."""

TEXTS = {
    "en": """All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.
Everyone is entitled to all the rights and freedoms set forth in this Declaration, without distinction of any kind, such as race, colour, sex, language, religion, political or other opinion, national or social origin, property, birth or other status.
Everyone has the right to life, liberty and security of person. No one shall be held in slavery or servitude; slavery and the slave trade shall be prohibited in all their forms. No one shall be subjected to torture or to cruel, inhuman or degrading treatment or punishment.
Everyone has the right to recognition everywhere as a person before the law. All are equal before the law and are entitled without any discrimination to equal protection of the law. Everyone who works has the right to rest and leisure, including reasonable limitation of working hours and holidays with pay. When this was not what they had been told, we were there with you and your friends; but which of them would have said so if it had been made for him?""",
    "de": """Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.
Jeder hat Anspruch auf die in dieser Erklärung verkündeten Rechte und Freiheiten ohne irgendeinen Unterschied, etwa nach Rasse, Hautfarbe, Geschlecht, Sprache, Religion, politischer oder sonstiger Überzeugung, nationaler oder sozialer Herkunft, Vermögen, Geburt oder sonstigem Stand.
Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Niemand darf in Sklaverei oder Leibeigenschaft gehalten werden; Sklaverei und Sklavenhandel sind in allen ihren Formen verboten. Niemand darf der Folter oder grausamer, unmenschlicher oder erniedrigender Behandlung oder Strafe unterworfen werden.
Jeder hat das Recht, überall als rechtsfähig anerkannt zu werden. Alle Menschen sind vor dem Gesetz gleich und haben ohne Unterschied Anspruch auf gleichen Schutz durch das Gesetz. Wenn ich das nicht gewusst hätte, wäre es auch für uns noch schwer gewesen, aber dann kam ein Mann von dem Schiff und wir hatten einen Tag, der uns zu dem führte, was man sich wünscht.""",
    "fr": """Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.
Chacun peut se prévaloir de tous les droits et de toutes les libertés proclamés dans la présente Déclaration, sans distinction aucune, notamment de race, de couleur, de sexe, de langue, de religion, d'opinion politique ou de toute autre opinion, d'origine nationale ou sociale, de fortune, de naissance ou de toute autre situation.
Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. Nul ne sera tenu en esclavage ni en servitude; l'esclavage et la traite des esclaves sont interdits sous toutes leurs formes. Nul ne sera soumis à la torture, ni à des peines ou traitements cruels, inhumains ou dégradants.
Chacun a le droit à la reconnaissance en tous lieux de sa personnalité juridique. Tous sont égaux devant la loi et ont droit sans distinction à une égale protection de la loi. Quand nous étions là avec elle, il y avait aussi une vieille maison qui n'était pas pour vous, mais que je pouvais voir au bord du chemin avant qu'elle ne soit vendue.""",
    "es": """Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.
Toda persona tiene todos los derechos y libertades proclamados en esta Declaración, sin distinción alguna de raza, color, sexo, idioma, religión, opinión política o de cualquier otra índole, origen nacional o social, posición económica, nacimiento o cualquier otra condición.
Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. Nadie estará sometido a esclavitud ni a servidumbre; la esclavitud y la trata de esclavos están prohibidas en todas sus formas. Nadie será sometido a torturas ni a penas o tratos crueles, inhumanos o degradantes.
Todo ser humano tiene derecho, en todas partes, al reconocimiento de su personalidad jurídica. Todos son iguales ante la ley y tienen, sin distinción, derecho a igual protección de la ley. Cuando llegamos a la casa no había nadie, pero el hombre que nos esperaba dijo que ya era muy tarde para hacerlo y que ellos lo harían después con más gente.""",
    "pt": """Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.
Todos os seres humanos podem invocar os direitos e as liberdades proclamados na presente Declaração, sem distinção alguma, nomeadamente de raça, de cor, de sexo, de língua, de religião, de opinião política ou outra, de origem nacional ou social, de fortuna, de nascimento ou de qualquer outra situação.
Todo o indivíduo tem direito à vida, à liberdade e à segurança pessoal. Ninguém será mantido em escravatura ou em servidão; a escravatura e o trato dos escravos, sob todas as formas, são proibidos. Ninguém será submetido a tortura nem a penas ou tratamentos cruéis, desumanos ou degradantes.
Todos os indivíduos têm direito ao reconhecimento em todos os lugares da sua personalidade jurídica. Todos são iguais perante a lei e, sem distinção, têm direito a igual proteção da lei. Quando chegamos não havia ninguém, mas ele disse que já era muito tarde para fazer isso e que eles não o fariam mais depois com uma pessoa que você não conhece.""",
    "id": """Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan.
Setiap orang berhak atas semua hak dan kebebasan yang tercantum di dalam Pernyataan ini dengan tidak ada pengecualian apa pun, seperti pembedaan ras, warna kulit, jenis kelamin, bahasa, agama, politik atau pandangan lain, asal-usul kebangsaan atau kemasyarakatan, hak milik, kelahiran ataupun kedudukan lain.
Setiap orang berhak atas kehidupan, kebebasan dan keselamatan sebagai individu. Tidak seorang pun boleh diperbudak atau diperhambakan; perbudakan dan perdagangan budak dalam bentuk apa pun mesti dilarang. Tidak seorang pun boleh disiksa atau diperlakukan secara kejam, diperlakukan atau dihukum secara tidak manusiawi atau dihina.
Setiap orang berhak atas pengakuan di depan hukum sebagai manusia pribadi di mana saja ia berada. Semua orang sama di depan hukum dan berhak atas perlindungan hukum yang sama tanpa diskriminasi. Ketika kami sampai di sana belum ada siapa-siapa, tetapi orang itu berkata bahwa sudah terlambat untuk melakukannya dan kita akan kembali lagi nanti karena dia juga ingin melihat ini.""",
    "nl": """Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.
Een ieder heeft aanspraak op alle rechten en vrijheden, in deze Verklaring opgesomd, zonder enig onderscheid van welke aard ook, zoals ras, kleur, geslacht, taal, godsdienst, politieke of andere overtuiging, nationale of maatschappelijke afkomst, eigendom, geboorte of andere status.
Een ieder heeft het recht op leven, vrijheid en onschendbaarheid van zijn persoon. Niemand zal in slavernij of horigheid gehouden worden; slavernij en slavenhandel in iedere vorm zijn verboden. Niemand zal onderworpen worden aan folteringen, of aan een wrede, onmenselijke of onterende behandeling of bestraffing.
Een ieder heeft, waar hij zich ook bevindt, het recht als persoon erkend te worden voor de wet. Allen zijn gelijk voor de wet en hebben zonder onderscheid aanspraak op gelijke bescherming door de wet. Toen wij daar aankwamen was er nog niemand, maar die man zei dat het al te laat was om dit te doen en dat ze naar huis gingen als het niet meer kon.""",
    "ru": """Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.
Каждый человек должен обладать всеми правами и всеми свободами, провозглашенными настоящей Декларацией, без какого бы то ни было различия, как-то в отношении расы, цвета кожи, пола, языка, религии, политических или иных убеждений, национального или социального происхождения, имущественного, сословного или иного положения.
Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность. Никто не должен содержаться в рабстве или в подневольном состоянии; рабство и работорговля запрещаются во всех их видах. Никто не должен подвергаться пыткам или жестоким, бесчеловечным или унижающим его достоинство обращению и наказанию.
Каждый человек, где бы он ни находился, имеет право на признание его правосубъектности. Все люди равны перед законом и имеют право, без всякого различия, на равную защиту закона. Когда мы приехали, там еще никого не было, но он сказал, что уже поздно это делать и что они потом вернутся, если у нее будет время для того, чтобы это увидеть.
Утром старик открыл окно и посмотрел на улицу: у ворот стояла собака, а над рекой поднимался белый туман. Он надел пальто, взял ключ со стола и вышел из дома, потому что хотел купить хлеб и молоко. Никто не знал, почему вечером в саду горел свет и кто двигал тяжелые ящики возле двери. Дети смеялись, когда ветер качал старые деревья, и долго не могли понять, откуда доносится этот шум. Работа была закончена к обеду, поэтому все отдыхали на берегу.""",
}
