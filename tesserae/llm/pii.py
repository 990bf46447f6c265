"""Personal data: base patterns and information-theoretic sanitisation, with DataFrame functions alone.

Base kinds (email, ip, card, phone) are leftmost non-overlapping matches, those that fail a kind's test dropped.
Patterns are possessive and start at the border of a run, which changes no match but keeps long runs linear.

Terms: lower-cased words (letters) outside base matches are counted with the protected values of their text, over distinct
whole texts of the corpus. For a term t and a value e the disclosure is P(e | t) = texts with both / texts with t, and the
gain is log2(P(e | t) / P(e)) bits. A pair with at least `support` texts, `bits` of gain and `generalise` of disclosure marks t,
if t stands between at least `support` different pairs of neighbouring words (copies of one passage are one piece of evidence):
it is removed from `remove` up and generalised to [TERM] below that, wherever it stands.

Pairs are counted where they can pass alone. A value needs `support` texts, and not more than the share of the corpus that
`bits` allows; a term needs `support` of the texts with such values, and not more than the commonest value has over
`generalise`, counted over all texts with matches. A text gives as many pairs as it has such values times such terms, and they are added up before
they are shuffled. Words of all documents are compared with a Bloom filter of the terms (16 bits a term, half a
MB at most; beyond that it lets more words through) before the exact join, so few words are shuffled.

Null text is empty: no spans. Equal texts have equal spans. Terms that overlap base matches aren't spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_test, fresh, remove, stored

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "phone": "+"}
SUPPORT, BITS, REMOVE, GENERALISE = 3, 4.0, 0.9, 0.6
WORD = r"\p{L}+"
_SPAN = "array<struct<start:int,end:int,value:string>>"
_PART = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"
MOST_HASH_BITS = 22
_TERM_SPANS = "array<struct<start:int,end:int,removed:boolean>>"
_ANY = " or ".join(f"size({k}) > 0" for k in KINDS)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    n = F.char_length(digits)
    digit = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
    weight = lambda i: F.when((n - i) % 2 == 1, digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)).otherwise(digit(i))
    return F.when(n.between(16, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + weight(i)) % 10 == 0).otherwise(False)


_TESTS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(_PART),
    "card": _luhn,
    "phone": lambda v: F.char_length(_digits(v)).between(8, 15),
}


def occurrences(text: Column, pattern: str, wanted) -> Column:
    """Spans of a pattern's matches whose value is wanted, as code points, end exclusive: pieces between matches give the places."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc: Column, piece: Column) -> Column:
        first = acc["at"] + F.char_length(piece["gap"])
        end = first + F.coalesce(F.char_length(piece["value"]), F.lit(0))
        span = F.struct(first.alias("start"), end.alias("end"), piece["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(piece["value"].isNotNull() & wanted(piece["value"]), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(pieces, start, step)["spans"]


def with_base(docs: DataFrame) -> DataFrame:
    """(doc_id, key of the text, text, one array of spans for each base kind)."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = out.withColumn("key", F.md5("text"))
    return out.withColumns(base_spans(F.col("text")))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind."""
    return {k: F.when(F.instr(text, HINTS[k]) > 0 if k in HINTS else text.rlike("[0-9]"), occurrences(text, PATTERNS[k], _TESTS[k])).otherwise(F.array().cast(_SPAN)) for k in KINDS}


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def _outside(text: Column) -> Column:
    """The text with base matches left out."""
    spans = F.array_sort(F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        parts = F.array_append(acc["parts"], F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], " "), F.lit(" "), F.substr(text, acc["at"] + 1, F.char_length(text))))


def _bit_test(terms: DataFrame):
    return bit_test(F.col("term"), terms, MOST_HASH_BITS)


def disclosing_terms(light: DataFrame, texts: DataFrame, support: int = SUPPORT, bits: float = BITS, generalise: float = GENERALISE) -> tuple[DataFrame, list[str]]:
    """(term, disclosure) of words that give a protected value away, and the folders in use. `light` has the keys and base
    spans of all rows, and the texts of those with a match; `texts` has the key and text of all."""
    spark, paths = light.sparkSession, []

    def keep(df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, name, few=True)
        paths.append(path)
        return df

    none = spark.createDataFrame([], "term string, disclosure double"), paths
    values = F.array_distinct(F.concat(*[F.transform(k, lambda s: F.md5(F.lower(s["value"]))) for k in KINDS]))
    n_texts = light.select("key").distinct().count()
    owned = light.where(_ANY).select("key", F.explode(values).alias("value")).distinct()
    live = keep(owned.groupBy("value").agg(F.count("*").alias("n_value")).where((F.col("n_value") >= support) & (F.log2(F.lit(float(n_texts)) / F.col("n_value")) >= bits)), "pii-values")
    most = live.agg(F.max("n_value")).first()[0]
    if most is None:
        return none
    owned = keep(owned.join(live, "value").groupBy("key").agg(F.collect_list("value").alias("values"), F.max("n_value").alias("most")), "pii-owned")
    words = keep(light.where(_ANY).select("key", "text", *KINDS).dropDuplicates(["key"]).select("key", _words(_outside(F.col("text"))).alias("words")), "pii-words")
    body = keep(words.join(owned, "key").select("values", "most", "words"), "pii-live")
    near = F.col("words")
    around = F.transform(near, lambda w, i: F.struct(w.alias("term"), F.xxhash64(F.get(near, i - 1), F.get(near, i + 1)).alias("between")))
    settings = body.select(F.explode(F.array_distinct(around)).alias("w")).select("w.term", "w.between").distinct().groupBy("term").agg(F.count("*").alias("n_between"))
    terms = body.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("n_live"))
    terms = terms.where((F.col("n_live") >= support) & (F.col("n_live") * generalise <= most)).join(settings.where(F.col("n_between") >= support).select("term"), "term", "left_semi")
    terms = keep(terms.select("term"), "pii-terms")
    test = _bit_test(terms)
    if test is None:
        return none
    # of all texts with matches: a term that stands in many without these values falls out before the whole corpus is read for it
    near = words.select(F.explode(F.filter(F.array_distinct("words"), test)).alias("term")).groupBy("term").agg(F.count("*").alias("n_near"))
    terms = keep(near.where(F.col("n_near") * generalise <= most).join(terms, "term", "left_semi"), "pii-near")
    test = _bit_test(terms)
    if test is None:
        return none
    # a term that more texts have than the commonest value of this one allows isn't given away by this one
    pairs = body.select("values", "most", F.explode(F.filter(F.array_distinct("words"), test)).alias("term"))
    pairs = pairs.join(terms, (pairs["term"] == terms["term"]) & (terms["n_near"] * generalise <= pairs["most"])).select(terms["term"], "values")
    pairs = pairs.select("term", F.explode("values").alias("value")).groupBy("term", "value").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    pairs = pairs.join(terms, "term").where(F.col("n_both") >= generalise * F.col("n_near")).join(live, "value")
    pairs = keep(pairs.where(F.log2(F.col("n_both") / F.col("n_near") * n_texts / F.col("n_value")) >= bits), "pii-pairs")
    chosen = keep(pairs.select("term").distinct(), "pii-chosen")
    test = _bit_test(chosen)
    if test is None:
        return none
    seen = texts.select("key", F.explode(F.array_distinct(F.filter(_words(F.col("text")), test))).alias("term")).distinct()
    n_term = seen.join(chosen, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    judged = pairs.join(n_term, "term").withColumn("p", F.col("n_both") / F.col("n_term"))
    judged = judged.where((F.col("p") >= generalise) & (F.log2(F.col("p") * n_texts / F.col("n_value")) >= bits))
    judged = keep(judged.groupBy("term").agg(F.max("p").alias("disclosure")), "pii-terms")
    return judged, paths


def term_spans(light: DataFrame, texts: DataFrame, terms: DataFrame, remove: float = REMOVE) -> DataFrame:
    """(key, term: spans of disclosing words that don't touch base spans) of the texts that have any."""
    test = _bit_test(terms)
    if test is None:
        return light.where("false").select("key", F.array().cast(_TERM_SPANS).alias("term"))
    some = texts.where(F.exists(_words(F.col("text")), test))
    places = some.select("key", F.explode(occurrences(F.col("text"), WORD, lambda w: test(F.lower(w)))).alias("s"))
    places = places.select("key", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.lower(F.col("s.value")).alias("term")).distinct()
    hits = places.join(terms, "term").select("key", F.struct("start", "end", (F.col("disclosure") >= remove).alias("removed")).alias("s"))
    hits = hits.groupBy("key").agg(F.array_sort(F.collect_set("s")).alias("term"))
    base = light.where(_ANY).select("key", F.concat(*KINDS).alias("base")).dropDuplicates(["key"])
    hits = hits.join(base, "key", "left")
    clear = F.filter("term", lambda s: ~F.exists(F.coalesce("base", F.array().cast(_SPAN)), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return hits.select("key", clear.alias("term")).where("size(term) > 0")


def _learned(docs: DataFrame, remove_from: float, **thresholds: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keys and base spans of all rows, spans of disclosing words by key, and these words."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(F.md5("text").alias("key"), "text")
    light, _ = stored(with_base(docs).withColumn("text", F.when(F.expr(_ANY), F.col("text"))), "pii-base")
    terms, paths = disclosing_terms(light, texts, **thresholds)
    spans, _ = stored(term_spans(light, texts, terms, remove_from), "pii-spans", few=True)
    terms, _ = stored(terms, "pii-terms", few=True)
    remove(docs.sparkSession, *paths)
    return light.drop("text"), spans, terms


def find(docs: DataFrame, remove_from: float = REMOVE, **thresholds: float) -> DataFrame:
    """Per row: doc_id, key, spans of each base kind and of disclosing terms."""
    light, spans, _ = _learned(docs, remove_from, **thresholds)
    return light.join(spans, "key", "left").withColumn("term", F.coalesce("term", F.array().cast(_TERM_SPANS)))


def labelled(kind: str) -> Column:
    """kind:start:end of each span."""
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def sanitise(docs: DataFrame, remove_from: float = REMOVE, **thresholds: float) -> DataFrame:
    """The input's rows with base matches replaced by [EMAIL] and so on, disclosing terms removed or generalised to
    [TERM], and n_chars, where there is one, counted anew. Where spans overlap, the earliest and then the longest stays; null texts stay null.
    Base matches are found in place, so only rows that may have a disclosing term are shuffled."""
    _, spans, terms = _learned(docs, remove_from, **thresholds)
    key, term = fresh(docs, "key"), fresh(docs, "term")
    test = _bit_test(terms)
    if test is None:
        return _replaced(docs, None)
    maybe = fresh(docs, "maybe")
    marked = docs.withColumn(maybe, F.coalesce(F.exists(_words(F.col("text")), test), F.lit(False)))
    spans = spans.select(F.col("key").alias(key), F.col("term").alias(term))
    some = marked.where(maybe).drop(maybe)
    some = some.join(spans, F.md5(some["text"].cast("string")) == spans[key], "left")
    return _replaced(marked.where(~F.col(maybe)).drop(maybe), None).unionByName(_replaced(some, term).select(*docs.columns))


def _replaced(docs: DataFrame, term: str | None) -> DataFrame:
    """The rows with marks in the place of base matches and of the spans in column `term`."""
    text = F.col("text").cast("string")

    def mark(spans: Column, of) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), of(s).alias("mark")))

    marks = [mark(spans, (lambda shown: lambda s: F.lit(shown))(f"[{k.upper()}]")) for k, spans in base_spans(text).items()]
    if term:
        marks.append(mark(F.coalesce(F.col(term), F.array().cast(_TERM_SPANS)), lambda s: F.when(s["removed"], "").otherwise("[TERM]")))
    held = fresh(docs, "marks")
    out = docs.withColumn(held, F.array_sort(F.concat(*marks)))

    def step(acc: Column, m: Column) -> Column:
        new = m["start"] >= acc["at"]
        kept = F.concat(acc["out"], F.substr(text, acc["at"] + 1, m["start"] - acc["at"]), m["mark"])
        return F.struct(F.when(new, -m["back"]).otherwise(acc["at"]).alias("at"), F.when(new, kept).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(held, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.char_length(text))))
    some = F.coalesce(F.size(held) > 0, F.lit(False))
    out = out.withColumn("text", F.when(some, clean).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(held)
