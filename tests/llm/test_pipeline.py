"""The pipeline: each stage on what the one before kept, against what that stage promises; packing keeps its layout."""

import random
import re
from collections import Counter

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_failed(text):
    words = WORD.findall(text or "")
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words) < 20 or 100 * len(repeated) > 30 * len(words)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts = [], [docs.count()]
    before = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, before, SF)
        assert out.columns == list(P.COLUMNS)
        out = P.materialise(out, "test-stage")
        names.append(name)
        counts.append(out.count())
        if name == "quality rules":
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            kept = {r["doc_id"]: r["text"] for r in out.collect()}
            assert len(kept) == counts[-1] < counts[-2] and all(texts[i] == t for i, t in kept.items())
            assert not any(base_failed(t) for t in kept.values())
            assert len(kept) > 0.5 * sum(not base_failed(t) for t in texts.values())
        if name == "line dedup":
            lines = Counter(x.strip().lower() for r in out.collect() for x in {y for y in r["text"].split("\n") if len(y.strip()) >= 10})
            assert max(lines.values()) == 1
        if name == "n-gram Jaccard join":
            from test_operators import brute_components

            want = {c for _, c in brute_components([(r["doc_id"], r["text"]) for r in before.collect()]).values()}
            assert {r["doc_id"] for r in out.collect()} == want
        if name == "mixing sources to target weights":
            words = lambda df: sum(len(WORD.findall(r["text"])) for r in df.collect())
            assert abs(words(out) - words(before)) <= 20  # the targets share 100 % of all words
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            assert all(texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in out.collect())
        before = out
    packed = P.STAGES[-1][1](spark, before, SF).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert packed["length"].sum() > 0 and len(packed) >= counts[-1]


def test_run(spark):
    got = P.run(spark, SF).toPandas()
    assert set(got.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and len(got)


def test_rows_without_an_id_of_their_own(spark):
    """Rows whose doc_id is null or shared keep their own words through the mix, and their own texts before it."""
    r = random.Random(6)
    words = lambda n: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))
    rows = [(None, words(40 + i)) for i in range(6)] + [(7, words(n)) for n in (30, 90, 200)] + [(i, words(50)) for i in range(20, 30)]
    copy = rows[7][1] + " end"
    make = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    pairs = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert pairs(P.mix_sources(spark, make(rows), SF)) == Counter(rows)  # a single source gets all of its words
    got = pairs(P.near_duplicates(spark, make([*rows, (7, copy), (99, rows[7][1]), (7, rows[6][1])]), SF))
    assert sum(got[7, t] for t in (rows[7][1], copy)) == 1
    assert got - Counter({(7, copy): 1, (7, rows[7][1]): 1}) == Counter(rows) - Counter({(7, rows[7][1]): 1})
