"""Benchmark decontamination with DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.  A benchmark window
is ``size`` consecutive words of an item, or all of a shorter item.  The hashes of the
distinct windows form a set that is shipped with the scan, as long as there are at most
``MOST_BROADCAST`` of them; every document window is looked up there within its row.  Rows
with a hit then carry the text of just those windows to an exact join with the
benchmark's windows.  A larger benchmark takes the same steps, but its hash set meets the documents'
window hashes in a shuffle join.

Defined results: null and empty texts have no words and no hits; an item without words
has no window; windows that several items share count for each of them; repeated
documents are judged each for itself; an item's repeated rows count once; a null item
id takes no part; an empty benchmark hits nothing; a null doc_id is judged like any other; a text's words are held by
one row, however many; an empty table gives an empty table; further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 13
#: Distinct windows whose hashes may be shipped with the scan: 8 bytes each in the set.
MOST_BROADCAST = 200_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array for null."""
    # lower() would also change letters beyond A-Z, so it serves ASCII texts only
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    found = F.filter(F.split(lowered, _GAP), lambda w: w != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def _starts(array: Column, size: Column | int) -> Column:
    """The 1-based places at which a window of so many words begins."""
    last = F.size(array) - size + 1
    return F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(items: DataFrame, size: int = SIZE, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """window (its words joined by spaces), size, hash and the sorted distinct items that hold it."""
    split = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("_item"), words(F.col(text)).alias("_words")).where(F.size("_words") > 0)
    sized = split.withColumn("size", F.least(F.size("_words"), F.lit(size)))
    starts = sized.select("_item", "size", "_words", F.explode(_starts(F.col("_words"), F.col("size"))).alias("_at"))
    cut = F.slice("_words", F.col("_at"), F.col("size"))
    found = starts.select("_item", "size", F.xxhash64(cut).alias("hash"), F.array_join(cut, " ").alias("window")).distinct()
    return found.groupBy("window", "size", "hash").agg(F.sort_array(F.collect_list("_item")).alias("items"))


def _hits_of_size(n: int, hashes: list[int]) -> Column:
    """The windows of n words of _words whose hash is among hashes, with their text."""
    near = F.filter(_starts(F.col("_words"), n), lambda at: F.xxhash64(F.slice("_words", at, n)).isin(hashes))
    return F.transform(near, lambda at: F.struct(F.lit(n).alias("_size"), at.alias("_at"), F.array_join(F.slice("_words", at, n), " ").alias("_window")))


def _hashes_of_size(n: int) -> Column:
    """Place and hash of every window of n words of _words."""
    return F.transform(_starts(F.col("_words"), n), lambda at: F.struct(F.lit(n).alias("_size"), at.alias("_at"), F.xxhash64(F.slice("_words", at, n)).alias("hash")))


def find_hits(docs: DataFrame, items: DataFrame, size: int = SIZE, text: str = "text", item_id: str = "item_id", item_text: str = "text", most_broadcast: int = MOST_BROADCAST, carry: list[str] | None = None) -> DataFrame:
    """docs, or their columns carry, with n_words, the hit places _covered (arrays of the first and last word of each window) and _items.

    Both arrays are empty for a document without a hit.  With more than most_broadcast windows docs is
    scanned three times and must be a stored table, whose rows keep their order.
    """
    windows = benchmark_windows(items, size, item_id, item_text)
    found = windows.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes")).first()
    sizes = sorted(found["sizes"])
    own = list(docs.columns) if carry is None else carry
    held = docs.select(F.struct(*own).alias("_doc"), words(F.col(text)).alias("_words")).withColumn("_row", F.monotonically_increasing_id())
    empty = F.array().cast("array<struct<_size:int,_at:int,_window:string>>")

    if found["n"] <= most_broadcast:
        hashes = [r["hash"] for r in windows.select("hash").distinct().collect()]
        by_size = [_hits_of_size(n, hashes) for n in sizes]
        marked = held.select("_row", "_doc", F.size("_words").alias("n_words"), (F.concat(*by_size) if by_size else empty).alias("_hits"))
        facts = marked
    else:
        all_of = F.concat(*(_hashes_of_size(n) for n in sizes))
        facts = held.select("_row", "_doc", F.size("_words").alias("n_words"))
        places = held.select("_row", F.explode(all_of).alias("p")).select("_row", "p.*")
        places = places.join(windows.select("hash", F.col("size").alias("_size")).distinct(), ["hash", "_size"], "left_semi").groupBy("_row").agg(F.collect_list(F.struct("_size", "_at")).alias("_places"))
        again = held.select("_row", "_words").join(places, "_row")
        windows_of_docs = again.select("_row", F.explode(F.transform("_places", lambda p: F.struct(p["_size"].alias("_size"), p["_at"].alias("_at"), F.array_join(F.slice("_words", p["_at"], p["_size"]), " ").alias("_window")))).alias("_hit"))

    known = windows.select(F.col("window").alias("_window"), F.col("size").alias("_known_size"), "items")
    # a broadcast side has MOST_BROADCAST windows at most; larger ones are left to the planner
    known = F.broadcast(known) if found["n"] <= most_broadcast else known
    if found["n"] <= most_broadcast:
        # one row for each hit, or one without a hit: the rows of a document come together once
        rows = facts.select("_row", "_doc", "n_words", F.explode_outer("_hits").alias("_hit"))
        rows = rows.join(known, (F.col("_hit._window") == F.col("_window")) & (F.col("_hit._size") == F.col("_known_size")), "left")
        narrow = rows.groupBy("_row").agg(F.first("_doc").alias("_doc"), F.first("n_words").alias("n_words"), *_gathered())
    else:
        hits = windows_of_docs.join(known, (F.col("_hit._window") == F.col("_window")) & (F.col("_hit._size") == F.col("_known_size")))
        narrow = facts.join(hits.groupBy("_row").agg(*_gathered()), "_row", "left")
    nothing = F.array()
    return narrow.select("_doc.*", "n_words", F.coalesce("_covered", nothing.cast("array<struct<first:int,last:int>>")).alias("_covered"), F.coalesce("_items", nothing.cast(windows.schema["items"].dataType)).alias("_items"))


def _gathered() -> list[Column]:
    span = F.when(F.col("items").isNotNull(), F.struct(F.col("_hit._at").alias("first"), (F.col("_hit._at") + F.col("_hit._size") - 1).alias("last")))
    return [F.sort_array(F.collect_set(span)).alias("_covered"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("_items")]


def merged(covered: Column) -> Column:
    """Sorted spans of words, those that overlap or touch made one."""
    start = F.array().cast("array<struct<first:int,last:int>>")

    def step(done: Column, span: Column) -> Column:
        top = F.element_at(done, -1)
        wider = F.struct(top["first"].alias("first"), F.greatest(top["last"], span["last"]).alias("last"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= span["first"] - 1), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(covered, start, step)


def measure(docs: DataFrame, items: DataFrame, size: int = SIZE, keep: list[str] | None = None, text: str = "text", **more) -> DataFrame:
    """keep (default doc_id) with n_words, n_hit, n_items, items_sha256 and contaminated.

    contaminated: a word was hit, and at least one in twenty.
    """
    keep = keep if keep is not None else ["doc_id"]
    found = find_hits(docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text).alias("_text")), items, size, "_text", carry=[f"_k{i}" for i in range(len(keep))], **more)
    last = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    # spans come sorted by first word: add what reaches beyond the end so far
    n_hit = F.aggregate("_covered", last, lambda a, s: F.struct(F.greatest(a["end"], s["last"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(a["end"], s["first"] - 1))).alias("n")), lambda a: a["n"].cast("long"))
    names = F.array_join(F.sort_array(F.transform("_items", lambda i: i.cast("string"))), ",")
    wide = found.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"))
    return wide.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _pinned(value: Column) -> Column:
    """A struct with field v that the optimizer won't inline into lambdas or filters, so it's computed once a row."""
    return F.struct(F.monotonically_increasing_id().alias("_n"), value.alias("v"))


def _spans_in_row(docs: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    """docs with n_words and _covered, for windows that may be shipped: no document moves."""
    held = windows.select("size", "hash", "window").collect()
    texts, hashes = [r["window"] for r in held], sorted({r["hash"] for r in held})
    by_size = [F.filter(_hits_of_size(n, hashes), lambda h: h["_window"].isin(texts)) for n in sorted({r["size"] for r in held})]
    hits = F.concat(*by_size) if by_size else F.array().cast("array<struct<_size:int,_at:int,_window:string>>")
    split = docs.select(F.struct(*docs.columns).alias("_doc"), _pinned(words(F.col(text))).alias("_w"))
    marked = split.select("_doc", F.size("_w.v").alias("n_words"), F.col("_w.v").alias("_words"))
    spans = F.sort_array(F.transform(hits, lambda h: F.struct(h["_at"].alias("first"), (h["_at"] + h["_size"] - 1).alias("last"))))
    return marked.select("_doc", "n_words", _pinned(spans).alias("_c")).select("_doc.*", "n_words", F.col("_c.v").alias("_covered"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE, text: str = "text", **more) -> DataFrame:
    """docs without those that are contaminated, and without the hit words of the others.

    A document with hits that isn't contaminated keeps its other text as it was, but for
    the white space and marks between removed words; documents without hits stay untouched.
    """
    # the document travels as one struct, so its columns' names can't clash with ours
    whole = docs.select(F.struct(*docs.columns).alias("_d"), F.col(text).alias("_t"))
    windows = benchmark_windows(items, size, more.get("item_id", "item_id"), more.get("item_text", "text"))
    if windows.count() <= more.get("most_broadcast", MOST_BROADCAST):
        found = _spans_in_row(whole, windows, "_t")
    else:
        found = find_hits(whole, items, size, "_t", **more)
    hit = F.aggregate("_s.v", F.lit(0), lambda a, x: a + x["last"] - x["first"] + 1)
    marked = found.withColumn("_s", _pinned(merged(F.col("_covered")))).withColumn("_hit", hit)
    clean = marked.where(~((F.col("_hit") > 0) & (20 * F.col("_hit") >= F.col("n_words"))))
    # words and gaps alternate: word i of the text stands between gaps i and i + 1
    some = F.size("_s.v") > 0
    gaps = F.split(F.col("_t"), r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    kept = F.filter(F.split(F.col("_t"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")
    cut = clean.withColumn("_p", _pinned(F.when(some, F.struct(gaps.alias("gaps"), kept.alias("kept")))))
    inside = lambda i: F.exists("_s.v", lambda x: (x["first"] <= i) & (i <= x["last"]))
    piece = lambda w, i: F.when(inside(i + 1), F.lit("")).otherwise(F.concat(w, F.get("_p.v.gaps", i + 1)))
    left = F.concat(F.get("_p.v.gaps", F.lit(0)), F.array_join(F.transform("_p.v.kept", piece), ""))
    return cut.select(F.col("_d").withField(text, F.when(some, left).otherwise(F.col("_t"))).alias("_d")).select("_d.*")
