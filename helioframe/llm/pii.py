"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base expressions find e-mail addresses, IP addresses, card and phone numbers; these are the seeds. The
words next to an instance make lexical patterns (two before it, or the one after it, within CONTEXT
characters). Unseen instances are tokens between white space with a digit, an @ or an [at], and runs of
digit groups with spaces, that have the shape of a kind and touch no base span. Spark scores the bipartite
graph of patterns and instances: a pattern with at least MIN_SEEDS accepted instances is as sure as the mean
score of all distinct instances and tokens next to it, an instance as sure as its patterns taken together;
one that comes to MIN_SCORE is accepted, and so makes new patterns in the next round. Rounds go on until
nothing new is accepted, ROUNDS times at most. Accepted instances are added as spans of their kind; base
spans stay.

All steps take time in proportion to the text's matches: places come from running sums in blocks, spans that
touch are found in one pass over them in order, and contexts are cut from pieces of the text. The
expressions are written so that long runs of one class take linear time; they find the same matches
as the plain ones in the comments. Spans are in code points, the end exclusive. Null texts count as
empty; texts without findings have zeros and empty strings. Rows are reported one by one, those that repeat
an identifier too; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.llm.shared import written

KINDS = ["email", "ip", "card", "phone"]
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 16 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a kind's expression to be tried at all.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
#: Tokens that may be unseen instances, runs of digit groups with spaces, and the shapes of kinds.
TOKEN = r"(?<!\S)\S*(?:[0-9@]|\[at\]|\(at\))\S*+"
HAS_TOKEN = r"[0-9@]|\[at\]|\(at\)"
SPACED = r"(?<![0-9(+])\(?[0-9]{1,6}\)?(?:[ .\-/]{1,2}[0-9]{2,6}){1,6}(?![0-9])"
SHAPES = {"email": r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$|^[^@\s]+(?:\[at\]|\(at\))[^@\s]+$", "ip": r"^[0-9]{1,3}(?:[.:\-][0-9]{1,3}){3}$", "card": r"^(?:[0-9][ .\-]?){13,19}$", "phone": r"^\(?[0-9](?:[ ().\-/]{0,2}[0-9]){6,14}$"}
ROUNDS = 6
MIN_SEEDS = 5
MIN_SCORE = 0.8
#: Characters on either side in which a pattern's words are looked for.
CONTEXT = 256
#: Items of a block of running sums, and characters of a piece of text.
BLOCK = 128
PIECE = 512
SPAN = "struct<k:int,start:int,end:int,value:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, zero: Column, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column]) -> Column:
    """For each item, the values of all items before it combined.

    First per block of BLOCK items, then within each, as appending to an array copies it.
    """
    kind = "array<int>"

    def scan(part: Column, begin: Column, of: Callable[[Column], Column]) -> Column:
        step = lambda s, x: F.struct(combine(s["at"], of(x)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(part, F.struct(begin.alias("at"), F.array().cast(kind).alias("out")), step, lambda s: s["out"])

    def within(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, x: combine(s, value(x))))
        heads = scan(sums, zero, lambda x: x)
        return F.flatten(F.zip_with(blocks, heads, lambda b, h: scan(b, h, value)))

    last = F.floor((F.size(items) - 1) / BLOCK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(items) > 0, let(cut, within)).otherwise(F.array().cast(kind))


def placed(text: Column, pattern: str) -> Column:
    """The matches of a pattern: array of (value, start, end)."""

    def rows(pairs: Column) -> Column:
        before = running(pairs, F.lit(0), lambda x: F.length(x["gap"]) + F.length(x["hit"]), lambda a, b: a + b)
        place = lambda x, at: F.struct(x["hit"].alias("value"), (at + F.length(x["gap"])).alias("start"), (at + F.length(x["gap"]) + F.length(x["hit"])).alias("end"))
        return F.zip_with(pairs, before, place)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: let(F.arrays_zip(hits.alias("hit"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap")), rows))


def spans_of(matches: Column, k: int) -> Column:
    return F.transform(matches, lambda m: F.struct(F.lit(k).alias("k"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))


def apart(spans: Column, cover: Column) -> Column:
    """The spans (k, start, end, value) that touch none of cover, in order."""
    tag = lambda x, on: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(on).alias("on"), x["k"].alias("k"), x["value"].alias("value"))
    far = 2**31 - 1

    def free(every: Column) -> Column:
        ends = running(every, F.lit(0), lambda x: F.when(x["on"] == 1, x["end"]).otherwise(F.lit(0)), F.greatest)
        starts = F.reverse(running(F.reverse(every), F.lit(far), lambda x: F.when(x["on"] == 1, x["start"]).otherwise(F.lit(far)), F.least))
        alone = F.filter(F.arrays_zip(every.alias("x"), ends.alias("a"), starts.alias("b")), lambda z: (z["x"]["on"] == 0) & (z["a"] <= z["x"]["start"]) & (z["b"] >= z["x"]["end"]))
        return F.transform(alone, lambda z: F.struct(z["x"]["k"].alias("k"), z["x"]["start"].alias("start"), z["x"]["end"].alias("end"), z["x"]["value"].alias("value")))

    both = F.array_sort(F.concat(F.transform(spans, lambda x: tag(x, 0)), F.transform(cover, lambda x: tag(x, 1))))
    return F.when((F.size(spans) > 0) & (F.size(cover) > 0), let(both, free)).otherwise(spans)


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        # parts of any length: leading zeros out, then at most 255
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(|[1-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The valid base matches of a kind, as (k, start, end, value); k is the kind's place in KINDS."""
    found = F.filter(placed(text, BASE[kind]), lambda m: valid(kind, m["value"]))
    return F.when(text.rlike(NEEDS[kind]), spans_of(found, KINDS.index(kind))).otherwise(F.array().cast(f"array<{SPAN}>"))


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE characters; a long one goes by larger pieces first, as cutting one out reads all before it."""
    size = F.length(text)
    large = (F.ceil(F.sqrt(size.cast("double") / PIECE)) * PIECE).cast("int")

    def cut(t: Column, width: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / width).cast("int")), lambda k: F.substring(t, k * width + 1, width))

    several = F.flatten(F.transform(cut(text, large), lambda t: cut(t, F.lit(PIECE))))
    return F.when(size > PIECE, several).otherwise(F.array(text))


def between(parts: Column, start: Column, end: Column) -> Column:
    """The text from start to end, out of its pieces."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((F.greatest(end, F.lit(1)) - 1) / PIECE).cast("int")
    two = F.concat(F.coalesce(F.get(parts, first), F.lit("")), F.coalesce(F.get(parts, first + 1), F.lit("")))
    joined = F.when(last <= first + 1, two).otherwise(F.array_join(F.slice(parts, first + 1, F.greatest(last - first + 1, F.lit(0))), ""))
    return F.when(end > start, F.substring(joined, start - first * PIECE + 1, end - start)).otherwise(F.lit(""))


def before(parts: Column, start: Column) -> Column:
    """The two words before a place, lower case, digits as 0."""
    near = F.lower(between(parts, F.greatest(start - CONTEXT, F.lit(0)), start))
    return F.regexp_replace(F.regexp_extract(near, r"(\S+\s+\S+)\s*$", 1), "[0-9]", "0")


def after(parts: Column, end: Column, size: Column) -> Column:
    """The word after a place, lower case, digits as 0."""
    near = F.lower(between(parts, end, F.least(end + CONTEXT, size)))
    return F.regexp_replace(F.regexp_extract(near, r"^\s*(\S+)", 1), "[0-9]", "0")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, by kind, then start, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def occurrences(docs: DataFrame) -> DataFrame:
    """Per document (id, text): its base spans, and what the graph needs of seeds and unseen instances."""
    text, none = F.col("text"), F.array().cast(f"array<{SPAN}>")
    spaced = F.filter(placed(text, SPACED), lambda m: F.contains(m["value"], F.lit(" ")))
    end = F.lit(".,;:!?)")
    trimmed = F.transform(placed(text, TOKEN), lambda t: F.struct(F.lit(-1).alias("k"), t["start"].alias("start"), (t["start"] + F.length(F.rtrim(t["value"], end))).alias("end"), F.rtrim(t["value"], end).alias("value")))
    found = docs.withColumn("base", F.concat(*(base_spans(text, k) for k in KINDS)))
    found = found.withColumn("groups", F.when(text.rlike(r"[0-9)] \(?[0-9]"), apart(spans_of(spaced, -1), F.col("base"))).otherwise(none))
    found = found.withColumn("free", F.concat("groups", F.when(text.rlike(HAS_TOKEN), apart(trimmed, F.concat("base", "groups"))).otherwise(none)))
    found = found.withColumn("every", F.concat("base", "free")).withColumn("parts", F.when(F.size("every") > 0, pieces(text)).otherwise(F.array().cast("array<string>")))
    found = found.withColumn("size", F.length(text))
    seen = F.transform("every", lambda o: F.struct(o["k"].alias("k"), o["start"].alias("start"), o["end"].alias("end"), F.lower(o["value"]).alias("value"), before(F.col("parts"), o["start"]).alias("before"), after(F.col("parts"), o["end"], F.col("size")).alias("after")))
    return found.select("id", F.monotonically_increasing_id().alias("row"), F.transform("base", lambda b: F.struct(b["k"], b["start"], b["end"])).alias("base"), seen.alias("seen"))


def discovered(found: DataFrame) -> DataFrame:
    """row, k, start and end of the instances that sure patterns discover."""
    rows = found.select("row", F.explode("seen").alias("o")).select("row", "o.*")
    shapes = F.array_compact(F.array(*(F.when(F.col("value").rlike(SHAPES[kind]), F.lit(i)) for i, kind in enumerate(KINDS))))
    rows = rows.withColumn("kinds", F.when(F.col("k") >= 0, F.array("k")).otherwise(shapes)).withColumn("seed", (F.col("k") >= 0).cast("double"))
    rows = rows.withColumn("value", F.when(F.length("value") > 64, F.sha2("value", 256)).otherwise(F.col("value")))
    patterns = F.array(F.concat(F.lit("<"), F.col("before")), F.concat(F.lit(">"), F.col("after")))
    edges = rows.withColumn("pattern", F.explode(F.filter(patterns, lambda p: F.length(p) > 1))).groupBy("pattern", "value", "kinds").agg(F.max("seed").alias("seed"))
    edges = written(edges, "edges")
    # every instance next to a pattern weighs it, whatever its kind: one of no kind counts against it
    sizes = edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")).groupBy("pattern").agg(F.count("*").alias("n")).where(f"n >= {MIN_SEEDS}")
    graph = edges.withColumn("kind", F.explode("kinds")).groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed")).join(sizes, "pattern")
    graph = written(graph, "graph")
    score = graph.groupBy("kind", "value").agg(F.max("seed").alias("score"))
    accepted = -1
    for _ in range(ROUNDS):
        by_pattern = graph.join(score, ["kind", "value"]).groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.max("n").alias("n"), F.sum((F.col("score") >= MIN_SCORE).cast("int")).alias("known"))
        sure = by_pattern.where(f"known >= {MIN_SEEDS}").select("pattern", "kind", (F.col("s") / F.col("n")).alias("sure"))
        together = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.coalesce("sure", F.lit(0.0)), F.lit(1e-6)))))
        score = written(graph.join(sure, ["pattern", "kind"], "left").groupBy("kind", "value").agg(F.greatest(F.max("seed"), together).alias("score")), "scores")
        known = score.where(f"score >= {MIN_SCORE}").count()
        if known == accepted:
            break
        accepted = known
    seeds = graph.where("seed > 0").select("kind", "value").distinct()
    fresh = score.where(f"score >= {MIN_SCORE}").join(seeds, ["kind", "value"], "left_anti")
    places = rows.where("k < 0").withColumn("kind", F.explode("kinds"))
    return places.join(fresh.select("kind", "value"), ["kind", "value"]).select("row", F.col("kind").alias("k"), "start", "end")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base and all spans as arrays of (k, start, end), k being the place in KINDS."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = written(occurrences(texts), "found")
    more = discovered(found).groupBy("row").agg(F.collect_set(F.struct("k", "start", "end")).alias("more"))
    rows = found.select("id", "row", "base").join(more, "row", "left")
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", F.col("more")))
    return rows.select(F.col("id").alias(id_col), "base", every.alias("spans"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and n_discovered."""
    rows = find(docs, id_col, text_col)
    of_kind = F.transform("base", lambda b: b["k"])
    counts = [(F.size("base") - F.size(F.array_remove(of_kind, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select(id_col, *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_discovered"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets (identifiers must be unique)."""
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"))))
    spans = find(docs, id_col, text_col).select(F.col(id_col).alias("id"), ordered.alias("spans"))
    joined = docs.select(F.col(id_col).alias("id"), F.struct(*docs.columns).alias("row")).join(spans, "id")
    old = F.col("row")[text_col]
    joined = joined.withColumn("parts", pieces(F.coalesce(old, F.lit("")))).withColumn("done", running(F.col("spans"), F.lit(0), lambda x: x["end"], F.greatest))
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    # a span that begins within an earlier one is part of it
    put = F.zip_with("spans", "done", lambda x, at: F.when(x["start"] >= at, F.concat(between(F.col("parts"), at, x["start"]), F.get(names, x["k"]))).otherwise(F.lit("")))
    last = F.array_max(F.transform("spans", lambda x: x["end"]))
    new = F.concat(F.array_join(put, ""), between(F.col("parts"), last, F.length(old)))
    changed = F.when(F.size("spans") > 0, new).otherwise(old)
    return joined.select(*(changed.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
