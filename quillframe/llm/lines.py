"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Distinct lines are split into ``threshold + 1`` segments. A line within ``threshold``
edits of another, no longer than itself, contains at least one of the other's segments
unchanged, at a place shifted by no more than the edits beside it allow. So every line is
indexed by (its length, segment number, segment) and probes the lengths up to
``threshold`` shorter with the few substrings that can match, all cut from a copy with a byte for every character. A pair that meets passes a
bound on a few letter counts inside the join and on more of them after it, and a banded
bit-parallel edit distance decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import bound, saved, small

THRESHOLD = 2  # edits (insert, delete, replace) at most
MIN_CHARS = 20  # shorter lines are compared for equality alone, not by edits
BROADCAST_ROWS = 200_000  # counted rows of narrow tables that may be broadcast; beyond it Spark shuffles
BROADCAST_BYTES = 16 << 20  # and their measured bytes
WORD = r"[^\x20\x09-\x0D]"  # a line without such a character is blank and always stays
_FEW = " eantirosd"  # counted for every line, for the bound inside the join, six bits each
_LETTERS = "hlucmpgf"  # counted for lines that met


def _span(n: Column, segment: Column, threshold: int) -> tuple[Column, Column]:
    """0-based start and length of a segment of a line of ``n`` characters; they differ by one character at most."""
    start, end = [F.floor(n * i / F.lit(threshold + 1)).cast("int") for i in (segment, segment + 1)]
    return start, end - start


def one_byte_each(line: Column) -> Column:
    """The line with a byte for every character, ``?`` where it is not ASCII: edits of the line are at least the edits of
    these bytes, and a piece of them is cut without reading what stands before it."""
    return F.when(F.octet_length(line) == F.char_length(line), line).otherwise(F.regexp_replace(line, r"[^\x00-\x7F]", "?")).cast("binary")


def _keys(lines: DataFrame, cuts: list[tuple[int, int, int]], threshold: int) -> DataFrame:
    """Rows ``id, letters, key, less`` of every line and (segment, less, shift): the hash of the substring that lies ``shift``
    off the segment's place in a line ``less`` characters shorter, with that length. The cuts are rows, not an expression
    each, as the method that Spark writes for all of them would be too long to be compiled."""
    cut = F.array(*[F.struct(F.lit(i).alias("segment"), F.lit(less).alias("less"), F.lit(shift).alias("shift")) for i, less, shift in cuts])
    rows = lines.select("id", "letters", one_byte_each(F.col("line")).alias("_b")).select("id", "letters", "_b", F.explode(cut).alias("c"))
    n = F.octet_length("_b")
    start, size = _span(n - F.col("c.less"), F.col("c.segment"), threshold)
    at = start + F.col("c.shift")
    inside = rows.where((at >= 0) & (at + size <= n) & (n > F.col("c.less")))
    return inside.select("id", "letters", F.xxhash64(n - F.col("c.less"), F.col("c.segment"), F.substring("_b", at + 1, size)).alias("key"), F.col("c.less").alias("less"))


def index_rows(lines: DataFrame, threshold: int) -> DataFrame:
    """Rows ``id, letters, key`` of every line and segment."""
    return _keys(lines, [(i, 0, 0) for i in range(threshold + 1)], threshold).drop("less")


def probe_rows(lines: DataFrame, threshold: int) -> DataFrame:
    """Rows ``id, letters, key, less`` of every line: the substrings that can equal a segment of a line ``less`` characters shorter
    (without the segments in their own place, which are the line's index keys).

    If segment i (from 0) is the first that is unchanged in place, at most i edits lie to
    its left and ``threshold - i`` to its right; so its place shifts by -i .. i seen from
    the left end, and by the same rule seen from the right end.
    """
    cuts = []
    for i in range(threshold + 1):
        for less in range(threshold + 1):
            for shift in range(max(-i, less - (threshold - i)), min(i, less + (threshold - i)) + 1):
                if less or shift:  # else the index key of the line itself
                    cuts.append((i, less, shift))
    return _keys(lines, cuts, threshold)


def with_letter_counts(lines: DataFrame, name: str, letters: str) -> DataFrame:
    """``lines`` and in column ``name`` how often each of up to ten ASCII letters stands in ``line``, modulo 64, six bits each.
    A letter that is counted is cut out before the next is looked for."""
    left, cut, out = "line", lines, F.lit(0).cast("long")
    for i, c in enumerate(letters):
        cut = cut.withColumn(f"_l{i}", F.replace(left, F.lit(c), F.lit("")))
        count = (F.octet_length(left) - F.octet_length(f"_l{i}")).cast("long").bitwiseAND(F.lit(63))
        left, out = f"_l{i}", out.bitwiseOR(F.shiftleft(count, 6 * i))
    return cut.select(*lines.columns, out.alias(name))


def letters_apart(a: Column, b: Column, letters: str) -> Column:
    """Lower bound of twice the edits: an edit changes one count by one, or two counts."""
    out = F.lit(0)
    for i in range(len(letters)):
        d = F.abs(F.shiftright(a, 6 * i).bitwiseAND(F.lit(63)) - F.shiftright(b, 6 * i).bitwiseAND(F.lit(63)))
        out = out + F.least(d, 64 - d)
    return out


def _without_common_head(pair: Column) -> Column:
    """Both strings (fields ``a`` and ``b``, reversed on the way out) without the 16-character pieces that they begin with alike."""
    pieces = F.zip_with(*[F.regexp_extract_all(pair[s], F.lit("(?s).{1,16}"), F.lit(0)) for s in "ab"], lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(pieces, False)
    same = F.when(first > 0, 16 * (first - 1)).otherwise(F.least(F.char_length(pair["a"]), F.char_length(pair["b"]))).cast("int")
    return bound(same, lambda n: F.struct(*[F.reverse(pair[s].substr(n + 1, F.char_length(pair[s]))).alias(s) for s in "ab"]))


def without_common_ends(a: Column, b: Column) -> Column:
    """The two strings, as fields ``a`` and ``b``, without common pieces at either end: their distance stays what it is."""
    return bound(bound(F.struct(a.alias("a"), b.alias("b")), _without_common_head), _without_common_head)


def within_edits(long: Column, short: Column, threshold: int) -> Column:
    """Whether two strings, the first no shorter, are within ``threshold`` edits: banded bit-parallel dynamic programming.

    Column j of the table is kept as two bit vectors of the vertical differences (+1, -1)
    in the rows j - threshold .. j + threshold. The score is followed along the diagonal
    that ends in the last cell: it grows where the diagonal difference is one.
    """
    k = threshold
    mask = F.lit((1 << (2 * k + 2)) - 1)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    gap = F.char_length(long) - F.char_length(short)

    def flat_step(s: Column) -> Column:
        """One column: ``flat`` has the rows where the diagonal difference is zero."""
        up, down, flat = s["up"], s["down"], s["flat"]
        right = down.bitwiseOR(F.bitwise_not(flat.bitwiseOR(up)).bitwiseAND(mask))
        below = F.shiftright(flat, 1)
        grown = one - F.call_function("shiftright", flat, s["diagonal"]).bitwiseAND(one)
        return F.struct(flat.bitwiseAND(up).bitwiseOR(F.bitwise_not(below.bitwiseOR(right)).bitwiseAND(mask)).alias("up"),
                        below.bitwiseAND(right).alias("down"), (s["score"] + grown).alias("score"))

    def column(pair: Column) -> Column:
        rows, columns, diagonal = pair["rows"], pair["columns"], (pair["gap"] + k).cast("int")

        def step(state: Column, j: Column) -> Column:
            def with_char(c: Column) -> Column:
                same = zero
                for p in range(2 * k + 1):  # bit p is row j - k + p, 1-based
                    same = same.bitwiseOR(F.when(F.get(rows, j - k + p - 1) == c, F.lit(1 << p).cast("long")).otherwise(zero))

                def with_same(m: Column) -> Column:
                    up = state["up"]
                    flat = (m.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(m).bitwiseOR(state["down"]).bitwiseAND(mask)
                    return bound(F.struct(up.alias("up"), state["down"].alias("down"), state["score"].alias("score"),
                                          flat.alias("flat"), diagonal.alias("diagonal")), flat_step)

                return bound(same, with_same)

            return bound(F.get(columns, j - 1), with_char)

        first = F.struct(F.lit((((1 << (2 * k + 2)) - 1) >> k) << k).cast("long").alias("up"), zero.alias("down"), pair["gap"].cast("long").alias("score"))
        return F.aggregate(F.sequence(F.lit(1), F.size(columns)), first, step)["score"]

    pair = F.struct(F.split(long, "").alias("rows"), F.split(short, "").alias("columns"), gap.alias("gap"))
    score = F.when(F.char_length(short) == 0, gap.cast("long")).otherwise(bound(pair, column))
    return F.when(gap > k, F.lit(False)).otherwise(score <= k)


def distinct_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every distinct line that is not blank, in the shared folder: ``line``, the place of its ``first``
    occurrence, how many ``times`` it occurs, and its ``id`` (a hash), length ``n`` and a few ``letters`` counts.

    A place is a number that grows with (doc_id, line number); null ids come last.
    """
    rows = _occurrences(docs, key, text).groupBy("line").agg(F.min("place").alias("first"), F.count("*").alias("times"))
    return saved(with_letter_counts(rows.withColumns({"id": _id(), "n": F.char_length("line")}), "letters", _FEW))


def _place(key: str, number: str) -> Column:
    base = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit((1 << 63) - 1)).cast("decimal(38,0)")
    return (base * F.lit(1 << 32) + F.col(number)).cast("decimal(38,0)")


def _occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    lines = docs.select(F.col(f"`{key}`"), F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("number", "line"))
    return lines.where(F.col("line").rlike(WORD)).select("line", _place(key, "number").alias("place"))


def _id(line: str = "line") -> Column:
    return F.xxhash64(line)


def edit_links(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Rows ``line_a, first_a, line_b, first_b``: all pairs of different lines within ``threshold`` edits, a no shorter than b.

    ``lines`` holds distinct lines with ``first``, ``id``, ``n`` and ``letters``. No group is collected: pairs come
    from an equi-join on segment keys (adaptive execution splits a hot key), and only pairs
    that pass the letter-count bound leave it.
    """
    index = index_rows(lines, threshold).select("key", F.col("id").alias("b"), F.col("letters").alias("letters_b"))
    same = index.select("key", F.col("b").alias("a"), F.col("letters_b").alias("letters_a"))
    probe = probe_rows(lines, threshold).select("key", F.col("id").alias("a"), F.col("letters").alias("letters_a"), (F.col("less") > 0).alias("shorter"))
    alike = letters_apart(F.col("letters_a"), F.col("letters_b"), _FEW) <= 2 * threshold
    met = same.join(index, "key").where((F.col("a") < F.col("b")) & alike).select("a", "b").unionByName(
        probe.join(index, "key").where((F.col("shorter") | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b")) & alike).select("a", "b"))
    pairs = saved(met.distinct())
    needed = pairs.select(F.col("a").alias("need")).unionByName(pairs.select(F.col("b").alias("need"))).distinct()
    some = lines.select("line", "first", "id").join(small(needed, BROADCAST_ROWS), F.col("id") == F.col("need")).drop("need")
    some = with_letter_counts(some, "more", _LETTERS)
    left = some.select(F.col("id").alias("a"), F.col("line").alias("line_a"), F.col("first").alias("first_a"), F.col("more").alias("more_a"))
    right = some.select(F.col("id").alias("b"), F.col("line").alias("line_b"), F.col("first").alias("first_b"), F.col("more").alias("more_b"))
    both = pairs.join(left, "a").join(right, "b").where(letters_apart(F.col("more_a"), F.col("more_b"), _LETTERS) <= 2 * threshold)
    near = bound(without_common_ends(F.col("line_a"), F.col("line_b")), lambda p: within_edits(p["a"], p["b"], threshold))
    return both.where(near).select("line_a", "first_a", "line_b", "first_b")


def line_verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """The distinct lines, and ``line, links, near`` of those with a link: how many different lines are within
    ``threshold`` edits, and whether one of them occurs earlier. Lines under ``min_chars`` have no links."""
    found = distinct_lines(docs, key, text)
    links = edit_links(found.where(F.col("n") >= min_chars), threshold)
    ends = links.select(F.explode(F.array(
        F.struct(F.col("line_a").alias("line"), (F.col("first_b") < F.col("first_a")).alias("earlier")),
        F.struct(F.col("line_b").alias("line"), (F.col("first_a") < F.col("first_b")).alias("earlier")))).alias("e")).select("e.*")
    linked = ends.groupBy("line").agg(F.count("*").alias("links"), F.max("earlier").alias("near"))
    return found, linked


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document that has a line to remove or a linked line: ``_id, _hash, repeats, nears, links, numbers``.

    ``numbers`` lists the line numbers to remove: all but the first occurrence of a line,
    and every line within ``threshold`` edits of another that occurs earlier. Lines are judged on
    the input, not on what is left.
    """
    found, linked = line_verdicts(docs, key, text, threshold, min_chars)
    facts = found.join(linked.withColumnRenamed("line", "_line"), F.col("line") == F.col("_line"), "left").drop("_line")
    told = facts.where("times > 1 or links is not null").select(
        _id().alias("_a"), F.xxhash64(F.lit(1), "line").alias("_b"), "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("near", F.lit(False)).alias("near"))
    texts = docs.select(F.col(f"`{key}`").alias("_id"), F.xxhash64(text).alias("_hash"), F.split(F.col(f"`{text}`"), "\n").alias("_lines"))
    rows = texts.select("_id", "_hash", F.posexplode("_lines").alias("number", "line"))
    rows = rows.where(F.col("line").rlike(WORD)).select(
        "_id", "_hash", "number", _id().alias("_la"), F.xxhash64(F.lit(1), "line").alias("_lb"))
    hit = rows.join(small(told, BROADCAST_ROWS), (F.col("_la") == F.col("_a")) & (F.col("_lb") == F.col("_b")))
    again = _place("_id", "number") > F.col("first")
    hit = hit.groupBy("_id", "_hash", "number").agg(F.max(again).alias("again"), F.max("near").alias("near"), F.max("links").alias("links"))
    gone = F.col("again") | F.col("near")
    return hit.groupBy("_id", "_hash").agg(
        F.count_if("again").cast("long").alias("repeats"), F.count_if(F.col("near") & ~F.col("again")).cast("long").alias("nears"),
        F.sum("links").cast("long").alias("links"), F.collect_list(F.when(gone, F.col("number"))).alias("numbers"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every row as ``row`` (its columns), the text without removed lines as ``kept``, and ``n_lines``, ``repeats``, ``nears``, ``links``.

    Lines are what stands between newlines. A null text stays null and has no lines; an
    empty text has one empty line. Blank lines always stay; lines under ``min_chars`` characters
    go if an equal one stands earlier, longer ones also if one within ``threshold`` edits does. Rows with
    the same id and text are one document and keep alike; other rows with the same id share
    its place in the order. ``links`` counts, over the document's lines, the different
    lines of the corpus within ``threshold`` edits.
    """
    removed = small(removed_lines(docs, key, text, threshold, min_chars), BROADCAST_ROWS, 64 + 4 * F.size("numbers"), BROADCAST_BYTES)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(row, F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t"), F.xxhash64(text).alias("_h"))
    out = d.join(removed, F.col("_k").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left")
    lines = F.split("_t", "\n")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.coalesce("numbers", F.array().cast("array<int>")), i)), "\n")
    zero = F.lit(0).cast("long")
    return out.select("row", F.when(F.size(F.coalesce("numbers", F.array().cast("array<int>"))) == 0, F.col("_t")).otherwise(kept).alias("kept"),
                      F.when(F.col("_t").isNull(), zero).otherwise(F.size(lines).cast("long")).alias("n_lines"),
                      *[F.coalesce(c, zero).alias(c) for c in ("repeats", "nears", "links")])


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """The documents with removed lines cut out; all columns stay, ``n_chars`` counts what is left."""
    out = dedup_lines(docs, **how)
    kinds = dict(docs.dtypes)
    new = F.col("kept")
    return out.select(*[new.alias(c) if c == "text" else F.char_length(new).cast(kinds[c]).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
