import random
import re

from pyspark.sql import functions as F
from helpers import documents, spark_rows, sql_rows

from pipecheck.llm import decontamination as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items, n=10):
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            for k in range(max(1, len(p) - n + 1) if p else 0):
                window = p[k : k + n]
                for at in range(len(w) - len(window) + 1):
                    if w[at : at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        found.add(str(item))
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def case(spark, seed=3):
    rng = random.Random(seed)
    vocabulary = ["the", "the", "of", "état", "X1", *(f"w{k}" for k in range(30))]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 10, 11, 14, 25]))) for _ in range(25)]
    passages += ["the the the the the the the the the the the the", "", "!?", passages[0], None]
    texts = []
    for _ in range(120):
        parts = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(0, len(parts) + 1)
            parts[at:at] = (rng.choice(passages) or "").upper().split()
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts))
    texts += [None, "", " . ", "the " * 40, passages[3], "État " * 12]
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    return documents(spark, texts), items, texts, passages


def test_against_brute_force_and_sql(spark):
    docs, items, texts, passages = case(spark)
    got = d.contamination(docs.withColumn("term", F.lit(1)), items.withColumn("pos", F.lit("x")))
    want = brute(list(enumerate(texts)), list(enumerate(passages)))
    rows = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["item_ids"])) for r in got.collect()}
    assert rows == want and sum(v[1] > 0 for v in want.values()) > 20
    sha = got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
    assert spark_rows(sha) == sql_rows(d.SQL, {"documents": docs, "benchmark": items})


def test_empty_tables_and_null_ids(spark):
    docs, items, *_ = case(spark)
    assert d.contamination(docs.limit(0), items).count() == 0
    assert d.contamination(docs, items.limit(0)).filter("contaminated or n_hit > 0 or n_items > 0").count() == 0
    odd = documents(spark, ["a b c", "a b c", "x a b c"], doc_id=[None, 5, 5])
    item = spark.createDataFrame([(None, "a b c"), (1, "a b c")], "item_id long, text string")
    rows = [(r["doc_id"], r["n_hit"], list(r["item_ids"])) for r in d.contamination(odd, item).collect()]
    assert sorted(rows, key=repr) == sorted([(None, 0, []), (5, 4, ["1"]), (5, 4, ["1"])], key=repr)


def test_proximity(spark):
    docs = documents(spark, ["q a x b y c q", "c b a", "a b", "a q q q q q b c", None, "b q c a"])
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    windows = d.test_windows(items)
    index = d.build_index(docs, windows.select(F.explode("terms").alias("term")))
    ranked = d.ranked_terms(windows, index)
    assert {r["doc_id"] for r in d.phrase_matches(index, ranked).collect()} == set()
    assert {(r["doc_id"], r["start"]) for r in d.proximity_matches(index, ranked, 2).collect()} == {(0, 1), (1, 0), (5, 0)}
    assert {r["doc_id"] for r in d.proximity_matches(index, ranked, 1).collect()} == {1, 5}


def brute_near(texts, passages, slack, n=10):
    windows = {tuple(p[k : k + n]) for p in map(words, passages) for k in range(max(1, len(p) - n + 1) if p else 0)}
    out = {}
    for doc, text in enumerate(texts):
        w = words(text)
        out[doc] = sum(w[at] in own and set(own) <= set(w[at : at + len(own) + slack]) for own in windows for at in range(len(w)))
    return out


def test_proximity_of_the_whole_table_against_brute_force(spark):
    docs, items, texts, passages = case(spark, 9)
    exact = {r["doc_id"]: r.asDict() for r in d.contamination(docs, items).collect()}
    for slack in (0, 3):
        got = {r["doc_id"]: r.asDict() for r in d.contamination(docs, items, slack=slack).collect()}
        near = {n: r.pop("n_near") for n, r in got.items()}
        assert got == exact and near == brute_near(texts, passages, slack)
        assert any(near[n] and not r["contaminated"] for n, r in exact.items()) and all(near[n] for n, r in exact.items() if r["contaminated"])
    assert d.contamination(docs.limit(0), items, slack=1).count() == 0
    assert d.contamination(docs, items.limit(0), slack=1).filter("n_near > 0").count() == 0


def test_index_of_phrases_keeps_words_beside_their_neighbours(spark, monkeypatch):
    held = {}

    def kept(df, name):
        held[name] = written(df, name)
        return held[name]

    written = d.written
    monkeypatch.setattr(d, "written", kept)
    common = " ".join(["the of"] * 300)
    texts = [f"{common} {' '.join(f'w{k}' for k in range(12))} {common}", common, "solo", "the", "w11 w10 w9", "w3 w4", None]
    items = spark.createDataFrame([(1, "the " + " ".join(f"w{k}" for k in range(12)) + " of"), (2, "solo")], "item_id long, text string")
    got = d.contamination(documents(spark, texts), items)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in got.collect()} == {
        0: (1212, 12, ["1"]), 1: (600, 0, []), 2: (1, 1, ["2"]), 3: (1, 0, []), 4: (3, 0, []), 5: (2, 0, []), 6: (0, 0, []),
    }
    # Of 1,200 common words next to others only those beside the passage are kept.
    assert held["postings"].filter("term is not null").count() < 100
    near = d.contamination(documents(spark, texts), items, slack=0)
    assert {r["doc_id"]: r["n_hit"] for r in near.collect()} == {r["doc_id"]: r["n_hit"] for r in got.collect()}
    assert held["postings"].filter("term = 'the'").count() == 901
