"""Near-duplicate lines by deletion neighbourhoods (operator 2); DataFrame functions only.

Two lines are near duplicates when they are equal, or when both have at least
``min_chars`` characters and are within the edit bound (characters inserted, deleted
or replaced).  The bound is one edit, or with ``per_chars`` one for every
``per_chars`` characters of the shorter line, and at least one.  A line is removed when an earlier line of the corpus, by (doc_id,
line number), is a near duplicate of it; lines are judged on the input, not on
what is left.  Blank lines are kept and not counted.

Equal lines are merged first.  Then each line emits the variants with one
character deleted, and itself, as hashed keys:

* two lines with the same variant by deletion at the same place differ by one
  replacement there, so all lines of such a key are near duplicates;
* a line that equals a variant of another is one deletion away from it.

So the earliest line of a key is all that its other lines must be joined with,
and a key shared by very many lines (numbered lines, say) costs one aggregate
row, never its pairs.  The joined lines are verified with ``levenshtein``.

Before that, a lossless filter: of two lines one edit apart, either the first
half of the shorter or the rest of it is untouched.  A line whose halves occur in
no other line cannot be one edit from another, and emits no variants.

Bounds of k > 1 edits (``per_chars``) go by segments: k + 1 disjoint segments of the
shorter line, dealt to its two ends, k1 + 1 and k2 + 1 with k1 + k2 + 1 = k.  So at
most k1 edits are in those of the start or at most k2 in those of the end, and from
that end some segment i is untouched with exactly i edits before it: it occurs in
the longer line, moved by at most i.  Each line emits its segments and all such
places, and whoever shares one is verified with ``levenshtein``: first with the
earliest line of the key, which settles most lines of a key shared by very many near
copies, then the lines still open with all others.  Nothing is capped, so the pairs
of a segment that very many unlike lines of like length share are all verified.

Edge cases: a NULL or empty text has no lines; rows equal in id and text are one
document listed twice, each listing gets its result; NULL ids come after all
others; an empty table gives an empty result.  Only ``doc_id`` and ``text`` are
read, so extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import pick, running_totals
from kpiforge.session import materialize

MIN_CHARS = 16
#: Cells of the filter on the way to the suspects' texts.
FILTER_CELLS = 1 << 20
#: Characters per permitted edit of the query with the growing bound.
PER_CHARS = 50
_PLACE = ["no_id", "doc_id", "text_key", "line_no"]


def lines(docs: DataFrame) -> DataFrame:
    """(no_id, doc_id, text_key, line_no, line, line_md5): every line that is not blank."""
    rows = pick(docs, "doc_id", "text").select(
        F.col("doc_id").isNull().alias("no_id"),
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    )
    return rows.filter(F.trim("line") != "").withColumn("line_md5", F.md5(F.col("line").cast("binary")))


def _half_keys(line: Column) -> list[Column]:
    """Keys of the halves, for a partner of equal length or one longer (m = n), or one shorter (m = n - 1)."""
    out, n = [], F.length(line)
    for less in (0, 1):
        m = n - less
        half = F.floor(m / 2).cast("int")
        out.append(F.xxhash64(F.lit("first"), m, F.substring(line, F.lit(1), half)))
        out.append(F.xxhash64(F.lit("rest"), m, F.substring(line, n - (m - half) + 1, m - half)))
    return out


def distinct_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """One row per distinct line: its earliest place and, if it is long enough, the keys of its halves."""
    keys = [F.when(F.length("line") >= min_chars, k).alias(f"k{i}") for i, k in enumerate(_half_keys(F.col("line")))]
    each = rows.select("line_md5", F.struct(*_PLACE).alias("place"), *keys)
    merged = each.groupBy("line_md5").agg(F.min("place").alias("place"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)])
    return materialize(merged, "line-distinct")


def _suspects(merged: DataFrame) -> DataFrame:
    """(line_md5, place) of the lines that share a half with another line."""
    keyed = merged.filter("k0 is not null").select(
        F.xxhash64("line_md5").alias("line_id"), F.explode(F.array("k0", "k1", "k2", "k3")).alias("key")
    )
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "line-shared")
    found = materialize(keyed.join(shared, "key", "left_semi").select("line_id").distinct(), "line-ids")
    return merged.select("line_md5", "place", F.xxhash64("line_md5").alias("line_id")).join(found, "line_id", "left_semi")


def _variants(suspects: DataFrame) -> DataFrame:
    """(v, i, rank): the hash of each line without its character i, and of the whole line (i = 0)."""
    line, i = F.col("line"), F.col("i")
    without = F.concat(F.substring(line, F.lit(1), i - 1), F.substring(line, i + 1, F.length(line)))
    placed = suspects.select("rank", "line", F.explode(F.sequence(F.lit(0), F.length(line))).alias("i"))
    return placed.select(F.xxhash64(F.when(i == 0, line).otherwise(without)).alias("v"), "i", "rank")


def _partners(variants: DataFrame) -> DataFrame:
    """(rank, earlier): each line with the earliest line of every key that it shares."""
    keys = variants.groupBy("v").agg(
        F.min(F.when(F.col("i") == 0, F.col("rank"))).alias("whole"),
        F.min(F.when(F.col("i") > 0, F.col("rank"))).alias("deleted"),
        F.min("rank").alias("least"),
        F.max("rank").alias("most"),
    )
    keys = materialize(keys.filter("least < most").drop("least", "most"), "line-keys")
    sharing = materialize(variants.join(keys, "v"), "line-sharing")
    one_off = sharing.select("rank", F.when(F.col("i") == 0, F.col("deleted")).otherwise(F.col("whole")).alias("earlier"))
    places = sharing.filter("i > 0").groupBy("v", "i").agg(F.min("rank").alias("earlier"), F.max("rank").alias("most"))
    places = materialize(places.filter("earlier < most").drop("most"), "line-places")
    replaced = sharing.join(places, ["v", "i"]).select("rank", "earlier")
    return one_off.unionByName(replaced).filter("earlier < rank").distinct()


def _ranked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rank, line_md5, line): the text of each line of ``wanted`` (line_md5, place), and its rank by place."""
    # Each suspect's text from its earliest place; a document listed twice gives it twice.
    # Lines of a hash cell without suspects stay out of the shuffle; at most FILTER_CELLS cells are broadcast.
    cell = F.pmod(F.xxhash64("line_md5"), F.lit(FILTER_CELLS)).cast("int")
    cells = wanted.select(cell.alias("cell")).distinct()
    near_rows = rows.withColumn("cell", cell).join(F.broadcast(cells), "cell", "left_semi")
    texts = near_rows.select("line_md5", "line", F.struct(*_PLACE).alias("at")).join(wanted, "line_md5").filter(F.col("at") == F.col("place"))
    texts = texts.select("line_md5", "line", *[F.col(f"place.{c}").alias(c) for c in _PLACE]).distinct()
    ordered = texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(0))).withColumn("one", F.lit(1))
    ranked = running_totals(ordered, [], _PLACE, "one", "rank", "line-ranks")
    return materialize(ranked.select("rank", "line_md5", "line"), "line-ranked")


def near_removed(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """(line_md5): the distinct lines that have an earlier line one edit away."""
    suspects = _suspects(merged).select("line_md5", *[F.col(f"place.{c}").alias(c) for c in _PLACE])
    wanted = suspects.select("line_md5", F.struct(*_PLACE).alias("place"))
    wanted = materialize(wanted, "line-suspects")
    ranked = _ranked(rows, wanted)
    variants = materialize(_variants(ranked), "line-variants")
    links = _partners(variants)
    left, right = ranked.select("rank", "line_md5", "line"), ranked.select(F.col("rank").alias("earlier"), F.col("line").alias("other"))
    checked = links.join(left, "rank").join(right, "earlier").filter(F.levenshtein("line", "other", 1) >= 0)
    return checked.select("line_md5").distinct()


def edit_bound(n: Column, per_chars: int) -> Column:
    """Edits between two lines that are near duplicates, the shorter of ``n`` characters."""
    return F.greatest(F.lit(1), F.floor(n / per_chars).cast("int"))


def _segments(rows: DataFrame, per_chars: int, who: str) -> DataFrame:
    """(who, n, at, segment, key): the segments of each line with a bound over one, and the places where another's may be.

    ``at`` counts from the line's end where side = 1.  From segment ``deep`` on the places of neighbours overlap:
    there every place is emitted once, under one number.
    """
    size = 2 * per_chars // 3  # (k + 1) * size <= k * per_chars for all k > 1
    deep = (size + 1) // 2
    n, t, m, i, at = (F.col(c) for c in ("n", "t", "m", "i", "at"))
    k = edit_bound(n, per_chars)
    half = F.floor(k / 2).cast("int")
    sides = rows.withColumn("n", F.length("line")).filter(n >= 2 * per_chars)
    # Four bytes a character: a place in a long line is then found without counting from its start.
    wide = F.encode("line", "UTF-32").alias("line")
    sides = sides.select(who, wide, "n", half.alias("h"), k.alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    sides = sides.select(who, "line", "n", "side", F.when(F.col("side") == 0, F.col("h")).otherwise(F.col("k") - F.col("h") - 1).alias("m"))
    few = F.least(m + 1, F.lit(deep))
    more = F.when(m >= deep, F.least(n - size, (size + 1) * m) - (size - 1) * deep + 1).otherwise(0)
    placed = sides.select("*", F.explode(F.sequence(F.lit(0), few * few + more - 1)).alias("t"))
    placed = placed.withColumn("i", F.when(t < deep * deep, F.floor(F.sqrt(t)).cast("int")).otherwise(deep))
    placed = placed.withColumn("at", F.when(t < deep * deep, i * size + t - i * i - i).otherwise((size - 1) * deep + t - deep * deep))
    placed = placed.filter((at >= 0) & (at <= n - size))
    own = F.when(t < deep * deep, t == i * i + i).otherwise((at % size == 0) & (at <= size * m))
    start = F.when(F.col("side") == 0, at + 1).otherwise(n - at - size + 1)
    key = F.xxhash64("side", "i", F.substring(F.col("line"), start * 4 - 3, F.lit(4 * size)))
    return placed.select(who, "n", "at", own.alias("segment"), key.alias("key"))


def _wide_suspects(rows: DataFrame, merged: DataFrame, per_chars: int) -> DataFrame:
    """(line_md5, place) of the lines that share a segment with another line."""
    keyed = _segments(rows.withColumn("line_id", F.xxhash64("line_md5")), per_chars, "line_id").select("key", "line_id", "segment")
    met = keyed.groupBy("key").agg(F.min("line_id").alias("least"), F.max("line_id").alias("most"), F.max("segment").alias("segment"))
    shared = materialize(met.filter("least < most and segment").select("key"), "line-wide-shared")
    cell = F.pmod("key", F.lit(FILTER_CELLS)).cast("int")
    cells = shared.select(cell.alias("cell")).distinct()
    likely = keyed.withColumn("cell", cell).join(F.broadcast(cells), "cell", "left_semi")
    found = materialize(likely.join(shared, "key", "left_semi").select("line_id").distinct(), "line-wide-ids")
    suspects = merged.select("line_md5", "place", F.xxhash64("line_md5").alias("line_id")).join(found, "line_id", "left_semi")
    return materialize(suspects.select("line_md5", "place"), "line-wide-suspects")


def _within(pairs: DataFrame, ranked: DataFrame, per_chars: int) -> DataFrame:
    """(rank): the later lines of the pairs (rank, earlier) that are within the edit bound."""
    left, right = ranked.select("rank", "line"), ranked.select(F.col("rank").alias("earlier"), F.col("line").alias("other"))
    both = pairs.join(left, "rank").join(right, "earlier")
    both = both.withColumn("k", edit_bound(F.least(F.length("line"), F.length("other")), per_chars))
    return both.filter(F.expr("levenshtein(line, other, k) >= 0")).select("rank").distinct()


def wide_removed(rows: DataFrame, merged: DataFrame, per_chars: int, min_chars: int) -> DataFrame:
    """(line_md5): the distinct lines with an earlier line within a bound of more than one edit."""
    ranked = _ranked(rows.filter(F.length("line") >= min_chars), _wide_suspects(rows.filter(F.length("line") >= min_chars), merged, per_chars))
    keyed = _segments(ranked, per_chars, "rank")
    met = keyed.groupBy("key").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.max("segment").alias("segment"), F.min_by("n", "rank").alias("first_n"))
    met = materialize(met.filter("first < last and segment").select("key", "first", "first_n"), "line-wide-keys")
    shared = materialize(keyed.join(met, "key"), "line-wide-sharing")
    k = edit_bound(F.least("n", "first_n"), per_chars)
    stars = shared.filter((F.col("first") < F.col("rank")) & (F.abs(F.col("n") - F.col("first_n")) <= k))
    stars = materialize(stars.select("rank", F.col("first").alias("earlier")).distinct(), "line-wide-stars")
    gone = materialize(_within(stars, ranked, per_chars), "line-wide-gone")
    still = shared.join(gone.withColumn("gone", F.lit(True)), "rank", "left").select("key", "rank", "n", "at", "segment", F.col("gone").isNull().alias("open"))
    still = materialize(still, "line-wide-open")
    short = still.filter("segment").select("key", *[F.col(c).alias(f"a_{c}") for c in ("rank", "n", "at", "open")])
    moved = F.abs(F.col("at") - F.col("a_at")) <= F.floor(F.col("a_at") / (2 * per_chars // 3))
    fits = (F.col("n") >= F.col("a_n")) & (F.col("n") - F.col("a_n") <= edit_bound(F.col("a_n"), per_chars)) & moved
    later_open = F.when(F.col("rank") > F.col("a_rank"), F.col("open")).when(F.col("rank") < F.col("a_rank"), F.col("a_open")).otherwise(False)
    pairs = still.join(short, "key").filter(fits & later_open)
    pairs = pairs.select(F.greatest("rank", "a_rank").alias("rank"), F.least("rank", "a_rank").alias("earlier")).distinct()
    pairs = materialize(pairs.join(stars, ["rank", "earlier"], "left_anti"), "line-wide-pairs")
    gone = gone.unionByName(_within(pairs, ranked, per_chars))
    return ranked.join(gone, "rank", "left_semi").select("line_md5")


def kept_lines(docs: DataFrame, min_chars: int = MIN_CHARS, per_chars: int | None = None) -> DataFrame:
    """(no_id, doc_id, text_key, line_no, line_md5): the places of the lines that stay."""
    rows = lines(docs)
    merged = distinct_lines(rows, min_chars)
    near = materialize(near_removed(rows, merged), "line-near")
    if per_chars is not None:
        near = near.unionByName(materialize(wide_removed(rows, merged, per_chars, min_chars), "line-wide"))
    stay = merged.join(near, "line_md5", "left_anti")
    return stay.select(*[F.col(f"place.{c}").alias(c) for c in _PLACE], "line_md5")


def summary(docs: DataFrame, min_chars: int = MIN_CHARS, per_chars: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) per row; the digest is of the kept lines' MD5s, joined by newlines."""
    key = ["no_id", "doc_id", "text_key"]
    stay = kept_lines(docs, min_chars, per_chars).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("line_no", "line_md5"))).alias("kept"))
    stay = materialize(stay, "line-kept").toDF("_no", "_doc", "_text", "kept")
    counted = pick(docs, "doc_id", "text").select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")), F.lit(0)).cast("long").alias("n_lines"),
    )
    match = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_text"))
    n_kept = F.coalesce(F.size("kept"), F.lit(0))
    n_lines = F.greatest(F.col("n_lines"), F.lit(0))
    digest = F.sha2(F.coalesce(F.array_join("kept.line_md5", "\n"), F.lit("")), 256)
    return counted.join(stay, match, "left").select(
        "doc_id", n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_removed"), digest.alias("kept_sha256")
    )


def apply(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text`` (blank lines stay)."""
    names = docs.columns
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    doc, text = (F.col(f"_c{names.index(c)}") for c in ("doc_id", "text"))
    stay = kept.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("_kept")).toDF("_doc", "_text", "_kept")
    match = doc.eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_text"))
    kept_at = F.coalesce("_kept", F.array().cast("array<int>"))
    left = F.filter(F.split(text, "\n"), lambda x, i: (F.trim(x) == "") | F.array_contains(kept_at, i))
    rows = inner.join(stay, match, "left")
    out = [F.array_join(left, "\n").alias(c) if n == "text" else F.col(c) for n, c in zip(names, inner.columns)]
    return rows.select(*out).toDF(*names)
