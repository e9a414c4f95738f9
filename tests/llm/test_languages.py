import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrove.llm.languages import CODES, OTHER, blocks, fit, label_code, label_languages, mislabelled, viterbi

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SENTENCES = {
    "en": "The old lantern was hanging near the door and nobody could see why it moved in the evening.",
    "de": "Die alte Laterne hing neben der Tür und niemand konnte sehen, warum sie sich am Abend bewegte.",
    "fr": "La vieille lanterne pendait près de la porte et personne ne pouvait voir pourquoi elle bougeait le soir.",
    "es": "La vieja linterna colgaba cerca de la puerta y nadie podía ver por qué se movía por la noche.",
    "pt": "A velha lanterna estava pendurada perto da porta e ninguém podia ver por que ela se movia à noite.",
    "id": "Lentera tua itu tergantung di dekat pintu dan tidak ada yang bisa melihat mengapa itu bergerak pada malam hari.",
    "nl": "De oude lantaarn hing naast de deur en niemand kon zien waarom hij in de avond bewoog.",
    "ru": "Старый фонарь висел у двери, и никто не мог понять, почему он двигался вечером.",
}


@pytest.fixture(scope="module")
def model():
    return fit([(k, v) for k, v in SENTENCES.items() for _ in range(3)] + [("en", SENTENCES["de"])])


def test_names():
    assert [label_code(x) for x in ("en-GB", "Deutsch", "français", "pt_BR", " NL ", "Русский", "bahasa indonesia", "ind")] == ["en", "de", "fr", "pt", "nl", "ru", "id", "id"]
    assert [label_code(x) for x in (None, "", "xx", "und", "n/a", "-", "unknown")] == [None] * 7


def test_blocks():
    text = "---\na: b\n---\n# Head\npara one\nstill one\n\n- item a\n- item b\n  more\n```\ncode\n```\n$$\nx\n$$\n| t |\nlast"
    assert [(a, b, l) for a, b, l, _ in blocks(text)] == [(5, 6, False), (8, 10, True), (18, 18, False)]
    assert blocks("") == [] and blocks("```\nopen") == []


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        s, c = rng.normal(size=(1, 5, 3)).astype(np.float32), np.abs(rng.normal(size=(1, 5))).astype(np.float32)
        value = lambda p: sum(s[0, k, x] for k, x in enumerate(p)) - sum(c[0, k] for k in range(1, 5) if p[k] != p[k - 1])  # noqa: B023, E731
        best = max((value(p), p) for p in np.ndindex(3, 3, 3, 3, 3))
        assert abs(value(viterbi(s, c)[0]) - best[0]) < 1e-4


def test_documents(spark, model):
    e, d = SENTENCES["en"], SENTENCES["de"]
    docs = [
        (1, f"{e} {e}", "en"), (2, e, "de"), (3, e, None), (4, f"{e}\n\n{d} {d}\n\n{e}", "english"), (5, f'{e} {e} {e} "{d.split(",")[0]}" {e}', "en"),
        (6, "", "en"), (7, None, None), (8, "```\ncode only\n```", "xx"), (9, "3 | 4\n5 | 6", None), (10, e.upper(), "en-US"), (11, f"- {d}\n- {d}\n\n{e}", "de"),
        (12, e, "en"), (12, e, "en"), (None, e, "en"), (13, (e + " ") * 1500, "fr"), (14, "第一章 漢字 かな 漢字 仮名 第二章。", "en"), (15, f"# {d}\n\n{e} {e}", "en"),
    ]
    df = spark.createDataFrame([(*x, "z") for x in docs], "doc_id bigint, text string, lang string, confidence string")
    got = {r.doc_id: r for r in label_languages(df, model=model).collect()}
    assert len(got) == 15 and all(got[k].lang_code == "en" and not got[k].is_case for k in (1, 5, 10, 12, 15))
    assert got[2].is_case and got[3].is_case and got[13].is_case and got[1].confidence > 0.99
    assert got[4].langs == ["en", "de"] and [s.lang_code for s in got[4].segments] == ["en", "de", "en"] and got[4].segments[1].line_start == 3
    assert [s.lang_code for s in got[5].segments] == ["en", "de", "en"] and got[5].langs == ["en"]
    assert all(got[k].lang_code is None and not got[k].is_case for k in (6, 7, 8, 9)) and got[14].lang_code == CODES[OTHER]
    rows = {tuple(r) for r in mislabelled(df, model=model).collect()}
    assert {(4, "en"), (4, "de"), (11, "de"), (11, "en"), (2, "en"), (3, "en"), (13, "en")} == rows
    assert mislabelled(df.limit(0)).count() == 0


@pytest.mark.parametrize("lang", sorted(SENTENCES))
def test_each_language(spark, model, lang):
    df = spark.createDataFrame([(1, SENTENCES[lang], lang)], "doc_id bigint, text string, lang string")
    assert label_languages(df, model=model).first().lang_code == lang


STRANGE = {
    "uk": "Старий ліхтар висів біля дверей, і ніхто не міг зрозуміти, чому він рухався ввечері.",
    "fi": "Vanha lyhty riippui oven vieressä eikä kukaan nähnyt miksi se liikkui illalla.",
    "sv": "Den gamla lyktan hängde bredvid dörren och ingen kunde se varför den rörde sig på kvällen.",
    "pl": "Stara latarnia wisiała obok drzwi i nikt nie widział, dlaczego poruszała się wieczorem.",
    "tr": "Eski fener kapının yanında asılıydı ve kimse akşamları neden hareket ettiğini göremiyordu.",
    "hu": "A régi lámpás az ajtó mellett lógott, és senki sem látta, miért mozgott este.",
}


@pytest.mark.parametrize("lang", sorted(STRANGE))
def test_text_in_no_known_language(spark, model, lang):
    df = spark.createDataFrame([(1, STRANGE[lang], "en"), (2, f"{SENTENCES['en']} {SENTENCES['en']}\n\n{STRANGE[lang]}", "en")], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in label_languages(df, model=model).collect()}
    assert got[1].lang_code == "und" and got[1].is_case and got[2].lang_code == "en" and [s.lang_code for s in got[2].segments][-1] == "und"
    assert {tuple(r) for r in mislabelled(df, model=model).collect()} == {(2, "en")}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy_without_labels(spark):
    """Fitted on half of the documents without any label, tested on the other half, against the labels that name a language
    (about a tenth of which are wrong) and against the model that also saw the labels."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.lang, r.text) for r in docs.select("doc_id", "lang", "text").collect() if r.text]
    blind = fit([(None, t) for d, _, t in rows if d % 2])
    held = docs.where("doc_id % 2 = 0")
    got = {r.doc_id: (r.lang_code, r.label_code) for r in label_languages(held, model=blind).collect() if r.lang_code}
    labelled = [(a, b) for a, b in got.values() if b]
    assert np.mean([a == b for a, b in labelled]) > 0.85
    seeing = fit([(lang, t) for d, lang, t in rows if d % 2])
    other = {r.doc_id: r.lang_code for r in label_languages(held, model=seeing).collect()}
    assert np.mean([other[d] == a for d, (a, _) in got.items()]) > 0.995
    no_labels = docs.withColumn("lang", F.lit(None).cast("string"))
    assert label_languages(no_labels.repartition(7)).select("doc_id", "lang_code").exceptAll(label_languages(no_labels.coalesce(1)).select("doc_id", "lang_code")).count() == 0
