"""Personal data: patterns for protected entities, and terms that give an entity away by what they tell about it.

Base spans (e-mail, IP address, card number, phone number) come from patterns. Protected entities are the base
spans' texts and their parts: domain and name of an address, network of an IP address, area of a phone number.
For each entity e and term t the corpus gives the numbers of documents n(e), n(t), n(e, t) of N. The term discloses
    PMI(e, t) = ln(N n(e, t) / (n(e) n(t)))    of the    IC(e) = ln(N / n(e))
that the entity itself carries. In a document that holds e, terms with PMI >= REMOVE * IC are removed, those
with PMI >= GENERALISE * IC are replaced by their kind. Two conditions make it evidence: the pair is seen in
SUPPORT texts of different classes, and chance is ruled out: with c classes, c * PMI >= SURE * ln(N). Copies and
near copies are one class: texts that share a band of MinHash values over their shingles of five words,
directly or through others.

Secrets are one more entity: long words of letters and digits that are assigned to a name (`name = "..."`). The
names are its terms: those that reach the threshold above tell a secret, and what is assigned to them is one.

DataFrame functions only. Positions are counted in code points: a text is split at the matches and the
lengths are added up. Only texts that hold an entity of enough classes are joined with their terms, only terms
that co-occur often enough are counted over the whole corpus, and in a text only its own terms are looked up.

Defined results: a null text is empty and has no spans; equal documents get equal spans; counts are of rows, so
repeated rows count as documents; an empty table gives an empty result; a null doc_id passes through; other
columns of any name pass through `sanitise`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, words_of

# The patterns. Possessive quantifiers and the look-behind (start of a run, or the end of the
# match before) leave the matches as they are and keep long runs from being tried at every start.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LETTERS = r"\p{L}\p{M}\p{N}_"
SECRET = r"[A-Za-z0-9_+-]{20,}+"
ASSIGNED = rf"(?<![{LETTERS}])[{LETTERS}]++\s*+[=:]\s*+[\"']?{SECRET}"

KINDS = ("email", "ip", "card", "phone")
SUPPORT, GENERALISE, REMOVE, SURE = 3, 0.8, 0.95, 1.5
SHINGLE, BANDS, BAND = 5, 8, 4
_SPAN = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"


def find_all(text: Column, pattern: Column, ord_: int, kind: str, valid) -> Column:
    """Spans of all matches for which valid(match) holds, in order: start, ord, end, kind, value."""
    found, parts = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = (start + F.char_length(x["value"])).cast("int")
        span = F.struct(start.cast("int").alias("start"), F.lit(ord_).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        out = F.when(valid(x["value"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.when(x["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), out.alias("out")))

    zipped = F.zip_with(parts, found, lambda part, m: F.struct(F.char_length(part).alias("gap"), m.alias("value")))
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.translate(m, "+ ().-", "")


def _ip_parts(m: Column) -> Column:
    bare = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(bare, lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))


def base_spans(text: Column) -> Column:
    """Base spans of a text, sorted by start, then kind."""
    none = F.array().cast(_SPAN)
    has = lambda s: F.contains(text, F.lit(s))
    number = text.rlike("[0-9]")
    size = lambda m, a, b: F.char_length(_digits(m)).between(a, b)
    return F.sort_array(
        F.concat(
            F.when(has("@"), find_all(text, F.lit(EMAIL), 0, "email", lambda m: F.lit(True))).otherwise(none),
            F.when(number, find_all(text, F.lit(IP), 1, "ip", _ip_parts)).otherwise(none),
            F.when(number, find_all(text, F.lit(CARD), 2, "card", lambda m: size(m, 12, 19) & F.call_function("luhn_check", _digits(m)))).otherwise(none),
            F.when(has("+"), find_all(text, F.lit(PHONE), 3, "phone", lambda m: size(m, 9, 15))).otherwise(none),
        )
    )


def guesses(text: Column) -> Column:
    """Words that may be secrets, with the names that they are assigned to: array of struct (cue, span)."""
    tail = lambda m: F.regexp_extract(m, f"{SECRET}$", 0)
    found = find_all(text, F.lit(ASSIGNED), 5, "secret", lambda m: tail(m).rlike("[0-9]") & tail(m).rlike("[A-Za-z]"))
    start = lambda s: (s["end"] - F.char_length(tail(s["value"]))).cast("int")
    both = F.transform(found, lambda s: F.struct(F.regexp_extract(s["value"], f"^[{LETTERS}]+", 0).alias("cue"), s.withField("start", start(s)).withField("value", tail(s["value"])).alias("span")))
    return F.when(text.rlike(r"[=:]\s*+[\"']?[A-Za-z0-9_+-]{20}"), both).otherwise(F.array().cast(f"array<struct<cue:string,span:{_SPAN[6:-1]}>>"))


def terms_of(text: Column) -> Column:
    """The different runs of letters, marks, digits and underscores of a text."""
    return F.array_remove(F.array_distinct(F.split(text, f"[^{LETTERS}]++", -1)), "")


def _entities(span: Column) -> Column:
    """A span's text and its parts, as names of entities."""
    value, kind = span["value"], span["kind"]
    part = lambda name, of, col: F.when(kind == of, F.concat(F.lit(f"{name}:"), col))
    return F.array_compact(
        F.array(
            F.concat_ws(":", kind, value),
            part("domain", "email", F.substring_index(value, "@", -1)),
            part("name", "email", F.substring_index(value, "@", 1)),
            part("net", "ip", F.substring_index(value, ".", 3)),
            part("area", "phone", F.regexp_replace(_digits(value), "[0-9]{4}$", "")),
        )
    )


def _without(text: Column, spans: Column) -> Column:
    """A text with a blank in the place of each span."""

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], kept, F.lit(" ")).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))


def text_classes(texts: DataFrame) -> DataFrame:
    """texts (_hash, text), different texts -> _hash, class: the smallest hash among texts that are linked by equal
    bands. A pair at similarity 0.8 shares one with 0.985, a pair at 0.3 with 0.06."""
    words = materialise(texts.select("_hash", words_of(F.col("text")).alias("words")), "words")
    n = F.greatest(F.size("words") - (SHINGLE - 1), F.lit(1))
    each = words.select("_hash", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice("words", i, SHINGLE)))).alias("h"))
    lows = each.groupBy("_hash").agg(*[F.min(F.xxhash64("h", F.lit(i))).alias(f"m{i}") for i in range(BANDS * BAND)])
    bands = F.array(*[F.xxhash64(F.lit(b), *[f"m{b * BAND + i}" for i in range(BAND)]) for b in range(BANDS)])
    marks = materialise(lows.select("_hash", F.explode(bands).alias("mark")), "text-marks")
    links = materialise(marks.join(marks.groupBy("mark").agg(F.count("*").alias("c")).where("c > 1").select("mark"), "mark"), "text-links")
    labels, done = links.select("_hash", F.col("_hash").alias("class")).distinct(), False
    while not done:
        least = links.join(labels, "_hash").groupBy("mark").agg(F.min("class").alias("least"))
        after = links.join(least, "mark").groupBy("_hash").agg(F.min("least").alias("least"))
        step = materialise(labels.join(after, "_hash"), "text-labels")
        labels, done = step.select("_hash", F.col("least").alias("class")), step.where("least < class").isEmpty()
    return texts.select("_hash").join(labels, "_hash", "left").withColumn("class", F.coalesce("class", "_hash"))


def disclosing_terms(docs: DataFrame, held: DataFrame, terms: DataFrame, cues: DataFrame, n_docs: int, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """entity, term, ratio = PMI / IC for the pairs that reach the threshold; entity `secret` with the names that tell one.

    docs: all documents (text); of the texts that hold entities, held: entity, _hash, n (documents with the text),
    class; terms: _hash, terms (array); cues: cue, _hash, n, class."""
    classes = lambda df, *by: df.groupBy(*by, "class").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("c")).where(F.col("c") >= support)
    secret = cues.select(F.lit("secret").alias("entity"), "_hash", "n", "class").distinct()
    strong = materialise(classes(held.unionByName(secret), "entity").select("entity", F.col("n").alias("n_e")), "entities")
    pairs = held.join(strong.select("entity"), "entity").join(terms, "_hash").select("entity", "n", "class", F.explode("terms").alias("term"))
    pairs = classes(pairs, "entity", "term").unionByName(classes(cues.select(F.lit("secret").alias("entity"), F.col("cue").alias("term"), "n", "class"), "entity", "term"))
    # n(t) >= n(e, t): the ratio can't reach the threshold unless it does so with n(t) = n(e, t), so all are tried
    pairs = materialise(pairs.select("entity", "term", F.col("n").alias("n_et"), "c"), "entity-terms")
    wanted = materialise(pairs.select("term").distinct(), "terms")
    every = docs.select(F.explode(terms_of(F.coalesce("text", F.lit("")))).alias("term"))
    n_t = every.groupBy("term").agg(F.count("*").alias("n_t")).join(wanted, "term", "left_semi")
    pmi = F.log(F.lit(float(n_docs)) * F.col("n_et") / (F.col("n_e") * F.greatest("n_t", "n_et")))
    ic = F.log(F.lit(float(n_docs)) / F.col("n_e"))
    both = pairs.join(n_t, "term").join(strong, "entity").withColumn("ratio", F.when(ic > 0, pmi / ic).otherwise(0.0))
    sure = F.col("c") * pmi >= SURE * F.log(F.lit(float(max(n_docs, 1))))
    return both.where((F.col("ratio") >= threshold) & sure).select("entity", "term", "ratio")


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, _hash (of a text that may hold spans), base (array of spans) and added (secrets,
    and spans of disclosing terms that touch neither base spans nor secrets, kind `remove` or `generalise`)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n_docs = docs.count()
    found = docs.withColumns({"base": base_spans(F.col("text")), "guess": guesses(F.col("text"))})
    some = (F.size("base") > 0) | (F.size("guess") > 0)
    found = materialise(found.select("doc_id", "base", "guess", F.when(some, text_hash(F.col("text"))).alias("_hash"), F.when(some, F.col("text")).alias("text")), "base-spans")
    texts = found.where("_hash IS NOT NULL").groupBy("_hash").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("text", "base", "guess")])
    texts = materialise(texts.withColumn("terms", terms_of(_without(F.col("text"), F.col("base")))), "span-texts")
    classes = materialise(text_classes(texts), "text-classes")
    held = texts.select("_hash", "n", F.explode(F.array_distinct(F.flatten(F.transform("base", _entities)))).alias("entity"))
    cues = texts.select("_hash", "n", F.explode(F.array_distinct(F.transform("guess", lambda g: g["cue"]))).alias("cue"))
    terms = texts.select("_hash", "terms")
    flagged = materialise(disclosing_terms(docs, held.join(classes, "_hash"), terms, cues.join(classes, "_hash"), n_docs), "disclosing-terms")

    names = flagged.where("entity = 'secret'").select(F.col("term").alias("cue"))
    secrets = texts.select("_hash", F.explode("guess").alias("g")).select("_hash", F.col("g.cue").alias("cue"), F.col("g.span").alias("span")).join(names, "cue")
    secrets = secrets.groupBy("_hash").agg(F.array_sort(F.collect_list("span")).alias("secrets"))
    told = held.join(flagged.select("entity").distinct(), "entity").join(terms, "_hash").select("_hash", "entity", F.explode("terms").alias("term")).join(flagged, ["entity", "term"])
    told = told.groupBy("_hash", "term").agg(F.max("ratio").alias("ratio")).groupBy("_hash").agg(
        F.collect_list("term").alias("told"), F.collect_list(F.when(F.col("ratio") >= REMOVE, F.col("term"))).alias("hard")
    )
    marked = texts.select("_hash", "text", "base").join(told, "_hash", "left").join(secrets, "_hash", "left").where("told IS NOT NULL OR secrets IS NOT NULL")
    none = F.array().cast(_SPAN)
    marked = materialise(marked.withColumn("secrets", F.coalesce("secrets", none)), "told-texts")
    hits = F.when(F.col("told").isNull(), none).otherwise(find_all(F.col("text"), F.lit(f"[{LETTERS}]++"), 4, "generalise", lambda m: F.array_contains("told", m)))
    taken = lambda h: F.exists(F.concat("base", "secrets"), lambda b: (h["start"] < b["end"]) & (b["start"] < h["end"]))
    named = F.transform(F.filter(hits, lambda h: ~taken(h)), lambda h: F.when(F.array_contains("hard", h["value"]), h.withField("kind", F.lit("remove"))).otherwise(h))
    added = materialise(marked.select("_hash", F.concat("secrets", named).cast(_SPAN).alias("added")), "added-spans")
    with_some = found.where("_hash IS NOT NULL").select("doc_id", "_hash", "base").join(added, "_hash", "left").withColumn("added", F.coalesce("added", none))
    return with_some.select("doc_id", "_hash", "base", "added").unionByName(found.where("_hash IS NULL").select("doc_id", "_hash", "base", none.alias("added")))


def text_hash(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every base span and secret replaced by its kind in brackets, terms of kind `generalise` by [term],
    and terms of kind `remove` taken out."""
    row, key, spans = (f"{name}_{uuid.uuid4().hex}" for name in ("row", "key", "spans"))  # docs may have columns of any name
    found = find_spans(docs, doc_id, text).where("_hash IS NOT NULL").select(F.col("_hash").alias(key), F.sort_array(F.concat("base", "added")).alias(spans)).dropDuplicates([key])
    body = F.coalesce(F.col(f"{row}.`{text}`"), F.lit(""))
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), text_hash(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias(key)).join(found, key, "left")

    def step(acc: Column, s: Column) -> Column:
        label = F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", "[term]").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        piece = F.concat(F.substring(body, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"])), label)
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], piece).alias("out")))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.char_length(body))))
    clean = F.when(F.size(spans) > 0, done).otherwise(F.col(f"{row}.`{text}`"))
    return joined.select(*[clean.alias(c) if c == text else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.select("doc_id", *map(n, KINDS), F.sha2(F.encode(spans_text(F.col("base")), "UTF-8"), 256).alias("base_sha256"), spans_text(F.sort_array(F.concat("base", "added"))).alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
