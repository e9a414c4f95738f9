import random

from inkgrove.llm.leaks import leaked_spans
from inkgrove.llm.words import words


def brute(docs, items, run=8):
    out = set()
    for d, t in docs:
        w = words(t or "")
        grams = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        for i, p in items:
            v = words(p or "")
            if any(tuple(v[k : k + run]) in grams for k in range(len(v) - run + 1)):
                out.add((d, i))
    return out


def test_words():
    assert words("Über-C<b>A</b>FÉ&nbsp;ea\u00adsy [[x|Alias]] [t](http://u.v/w) <!-- no --> n\u200bo_1") == [b"uber", b"cafe", b"easy", b"alias", b"t", b"no", b"1"]
    assert words("") == [] and words("Йод ёлка") == ["иод".encode(), "елка".encode()]


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(30)] + ["näme", "ÉTÉ"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30)))) for i in range(40)]
    docs = []
    for d in range(300):
        w = [rng.choice(vocabulary + ["other", "foreign"]) for _ in range(rng.randint(0, 80))]
        if d % 4 == 0:
            p = items[rng.randrange(40)][1].upper().split()
            at, n = rng.randint(0, max(0, len(p) - 3)), rng.randint(5, 20)
            w[10:10] = p[at : at + n]
        docs.append((d, ", ".join(w)))
    docs += [(900, None), (901, ""), (902, docs[0][1]), (903, "z " * 30_000)]
    items += [(900, None), (901, ""), (902, items[0][1])]
    dd, ii = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    rows = leaked_spans(dd, ii).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == brute(docs, items) and len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    blocks = leaked_spans(dd, ii, block_chars=300).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == {(r.doc_id, r.item_id) for r in rows}


def test_runs_and_edges(spark):
    passage = " ".join(f"t{k}" for k in range(20))
    docs = [(1, passage), (2, " ".join(passage.split()[3:12])), (3, " ".join(passage.split()[:7])), (4, f"<p>{passage.replace('t5', 't<b>5</b>')}</p>"), (None, passage)]
    dd = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, item_id string")
    ii = spark.createDataFrame([(7, passage, "x")], "item_id bigint, passage string, doc_id string")
    got = {r.doc_id: (r.shingles, r.of_shingles, r.longest_run, r.first_word) for r in leaked_spans(dd, ii).collect()}
    assert got == {1: (13, 13, 20, 0), 2: (2, 13, 9, 0), 4: (13, 13, 20, 0)}
    assert leaked_spans(dd.limit(0), ii).count() == 0 and leaked_spans(dd, ii.limit(0)).count() == 0


def test_text_behind_a_comment_that_never_ends_is_kept():
    assert words("a <!-- b --> c <!-- d <b>e</b> f") == [b"a", b"c", b"d", b"e", b"f"] and words("--> a <!-- b") == [b"a", b"b"]
    assert len(words("<!-- x " * 50_000)) == 50_000


def test_documents_are_read_once_whatever_the_number_of_item_blocks(spark):
    read = spark.sparkContext.accumulator(0)
    passages = [" ".join(f"q{i}x{k}" for k in range(12)) for i in range(6)]

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    docs = spark.createDataFrame([(d, f"see {passages[d % 6]} end") for d in range(60)], "doc_id bigint, text string").repartition(4).mapInPandas(counted, "doc_id bigint, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id bigint, passage string")
    got = leaked_spans(docs, items, block_chars=len(passages[0]) * 2 + 5)  # three blocks of two
    assert got.count() == 60 and read.value == 60


def test_a_shingle_shared_by_many_items_and_repeated_in_a_text(spark):
    common = " ".join(f"c{k}" for k in range(8))
    items = spark.createDataFrame([(i, f"{common} own{i} tail{i}") for i in range(2000)], "item_id bigint, passage string")
    docs = spark.createDataFrame([(1, f"{common} " * 500), (2, f"x {common} own7 tail7")], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.shingles, r.longest_run, r.first_word) for r in leaked_spans(docs, items).collect()}
    assert len(got) == 4000 and got[1, 7] == (1, 8, 0) and got[2, 7] == (3, 10, 1) and got[2, 8] == (1, 8, 1)


def test_rarity_is_counted_over_documents():
    import numpy as np

    from inkgrove.llm.leaks import Shingles, prefix_keys

    vocabulary = np.arange(10, 20)
    s = Shingles([(1, vocabulary.copy())], vocabulary, np.array([9, 9, 9, 1, 9, 9, 9, 9, 9, 9]), 8)
    assert s.rank[3] == 0 and set(prefix_keys(s.grams, s.rank, 8).tolist()) == {3, 2, 1}
    window, gram = s.match(np.concatenate([vocabulary[:9], [0], vocabulary[2:]]))
    assert window.tolist() == [0, 1, 10] and s.sum_up(window, gram, window)[1].tolist() == [3]
