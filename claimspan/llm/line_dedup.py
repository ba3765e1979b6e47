"""Line dedup: exact and near repeats of lines, across and within documents.

A line goes if an earlier line (by doc_id, then place) is at most EDITS insertions,
deletions or substitutions away. Lines are compared without white space around them. Lines under
MIN_CHARS code points are too short for edits to tell a repeat from chance; they go only as
exact repeats, from `exact_chars` code points on. The query and the pipeline ask for 1.

1. Exact repeats: lines meet by a 128-bit hash; the first place of each is a plain minimum,
   aggregated within tasks, so a line that makes up a third of all costs a row per task.
2. Near repeats, by segment partition: a line is split into EDITS + 1 segments, one of which
   survives EDITS edits unchanged. Each line's segments go into an index by length, segment
   number and content; each line probes the indexes of its own and EDITS shorter lengths with
   those substrings only that can still be aligned with the segment within the edits left on
   either side.
3. Index entries that no probe of another line meets are dropped before any text is moved; the
   few that are left are stored. They are verified by a semi-join, which keeps no pairs and
   stops at the first hit, with a banded bit-parallel edit distance behind three cheap
   necessary tests: the order, the parities of characters, and a second, finer split into
   segments, of which only as many as there are edits may be missing near their place.

Everything is DataFrame functions. White space around a line is space and the ASCII controls
tab to carriage return.

Defined results: null and empty texts stay as they are, and so do lines that are blank. A
document may end up empty, but stays. Documents with a null doc_id come last in order. Rows
with equal doc_id and text are treated alike: one doesn't remove the other's lines. Ties in
order can't occur. Extra columns pass through. What is left is joined by line feeds. Lines are
told apart, and rows joined, by hashes of 128 and 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimspan.llm.common import stored, stored_by

EDITS = 2
MIN_CHARS = 16
#: Segments of the second split, for each edit.
FINE = 3

LAST = 9223372036854775807


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__row", F.xxhash64("doc_id", "text"))


def _order(doc: str = "doc_id", at: str = "__at") -> Column:
    """One number that orders lines by document and place."""
    high = F.coalesce(F.col(doc), F.lit(LAST)).cast("decimal(20,0)")
    return (high * F.lit(1 << 32).cast("decimal(11,0)") + F.col(at)).cast("decimal(38,0)")


def _trimmed(line: Column | str) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _long_enough(trimmed: Column, least: int) -> Column:
    """Whether a line has `least` code points; short ones must not be blank."""
    long = F.length(trimmed) >= MIN_CHARS
    if least >= MIN_CHARS:
        return F.length(trimmed) >= least
    return long | ((F.length(trimmed) >= least) & trimmed.rlike(r"(?U)\S"))


def _lines(keyed: DataFrame, *more: str, least: int = MIN_CHARS) -> DataFrame:
    """The lines that are long enough, trimmed, with their places."""
    exploded = keyed.select("__row", "doc_id", *more,
                            F.posexplode(F.split("text", "\n")).alias("__at", "__line"))
    return exploded.withColumn("__line", _trimmed("__line")).where(
        _long_enough(F.col("__line"), least))


def exact_repeats(keyed: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """__row, doc_id, __at of lines that stood in an earlier place."""
    hashed = _lines(keyed, least=least).select("__row", "doc_id", "__at", _order().alias("__order"),
                                  F.xxhash64("__line").alias("h1"),
                                  F.xxhash64(F.lit(1), "__line").alias("h2"))
    first = hashed.groupBy("h1", "h2").agg(F.min("__order").alias("first"),
                                           F.count("*").alias("n")).where("n > 1").drop("n")
    return hashed.join(first, ["h1", "h2"]).where(F.col("__order") > F.col("first")).select(
        "__row", "doc_id", "__at")


def segments(length: Column, number: Column, edits: int) -> tuple[Column, Column]:
    """Begin (from 0) and size of a segment; the last ones take what is left over."""
    base = F.floor(length / (edits + 1)).cast("int")
    longer = length - base * (edits + 1)
    from_ = edits + 1 - longer  # number of the first longer segment
    return (base * number + F.greatest(number - from_, F.lit(0)),
            base + (number >= from_).cast("int"))


def places(edits: int = EDITS) -> list[tuple[int, int, int, int]]:
    """(segment, lengths below the line's own, shift, is a probe): what a line asks for.

    A segment can stand no further off its place than the edits to its left, nor, seen from
    the other end, than those to its right.
    """
    out = [(number, 0, 0, 0) for number in range(edits + 1)]
    for number in range(edits + 1):
        for shorter in range(edits + 1):
            low = max(-number, shorter - (edits - number))
            high = min(number, shorter + (edits - number))
            out += [(number, shorter, shift, 1) for shift in range(low, high + 1)]
    return out


def entries(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """lines with key and probe: a row for each index entry and each probe of `__line`."""
    asked = F.array(*[F.struct(F.lit(n).alias("number"), F.lit(less).alias("less"),
                               F.lit(shift).alias("shift"), F.lit(probe).alias("probe"))
                      for n, less, shift, probe in places(edits)])
    size = F.length("__line")
    each = lines.withColumn("e", F.explode(asked)).withColumn(
        "__length", size - F.col("e.less")).where(F.col("__length") >= MIN_CHARS)
    begin, width = segments(F.col("__length"), F.col("e.number"), edits)
    at = begin + F.col("e.shift")
    return each.where((at >= 0) & (at + width <= size)).withColumn(
        "key", F.xxhash64("__length", "e.number", F.substring("__line", at + 1, width))
    ).withColumn("probe", F.col("e.probe"))


def parity(line: Column) -> Column:
    """A bit per class of characters: whether their number is odd. An edit flips two at most."""
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)))


def alike(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether enough of a's segments stand in b near their place, for `edits` edits.

    An edit spoils one segment at most and moves the others by one place.
    """
    count = FINE * edits
    size = F.floor(F.length(a) / count).cast("int")
    found = [(F.instr(F.substring(b, F.greatest(size * i + (1 - edits), F.lit(1)),
                                  size + 2 * edits),
                      F.substring(a, size * i + 1, size)) > 0).cast("int")
             for i in range(count)]
    return sum(found[1:], found[0]) >= count - edits


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether the edit distance of two texts is at most `edits`, bit-parallel in a band.

    State d holds a bit for each of the 2 * edits + 1 diagonals: whether the prefix of b on
    that diagonal is within d edits of the prefix of a read so far. A step takes a character
    of a, and the bits where it equals b's character on the diagonal.
    """
    band = (1 << (2 * edits + 1)) - 1
    nothing = F.array_repeat(F.lit(None).cast("string"), edits)
    chars = F.concat(nothing, F.split(b, ""), nothing)
    # Column k of the zipped rows holds b's character on diagonal k for each place in a.
    zipped = F.arrays_zip(F.slice(F.split(a, ""), 1, F.length(a)).alias("a"), *[
        F.slice(chars, k + 1, F.length(a)).alias(f"b{k}") for k in range(2 * edits + 1)])

    def step(state: Column, row: Column) -> Column:
        equal = sum((F.coalesce((row["a"] == row[f"b{k}"]).cast("int"), F.lit(0)) * (1 << k)
                     for k in range(2 * edits + 1)), F.lit(0))
        new = [state["d0"].bitwiseAND(equal)]
        for d in range(1, edits + 1):
            here, less = state[f"d{d}"], state[f"d{d - 1}"]
            new.append(here.bitwiseAND(equal)
                       .bitwiseOR(F.shiftright(less, 1)).bitwiseOR(less)
                       .bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(band)))
        return F.struct(*[bits.cast("int").alias(f"d{d}") for d, bits in enumerate(new)])

    start = F.struct(*[F.lit(((1 << (d + 1)) - 1) << edits).alias(f"d{d}")
                       for d in range(edits + 1)])
    diagonal = F.length(b) - F.length(a) + edits
    reached = F.aggregate(zipped, start, step, lambda state: state[f"d{edits}"])
    return F.when((diagonal >= 0) & (diagonal <= 2 * edits), F.call_function(
        "shiftright", reached, diagonal).bitwiseAND(F.lit(1)) == 1).otherwise(False)


def _gone(places_: DataFrame, name: str) -> DataFrame:
    return places_.groupBy(F.col("__row").alias("__g_row")).agg(
        F.collect_set("__at").alias(name))


def _joined(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    return keyed.join(gone, F.col("__row") == F.col("__g_row"), "left")


def _stays(gone: str, at: Column) -> Column:
    return F.coalesce(~F.array_contains(gone, at), F.lit(True))


def near_repeats(first: DataFrame, edits: int = EDITS) -> DataFrame:
    """__row, doc_id, __at of lines with an earlier near line. `first` holds the documents'
    __row, doc_id, text and, in __gone, the places of exact repeats, which are left out."""
    lines = _lines(first, "__gone").where(_stays("__gone", F.col("__at")))
    key = Window.partitionBy("key")
    one = F.xxhash64("__row", "__at")
    shared = stored(entries(lines, edits).select("key", "probe", "__row", "__at")
                    .withColumn("lo", F.min("probe").over(key))
                    .withColumn("hi", F.max("probe").over(key))
                    .withColumn("a", F.min(one).over(key)).withColumn("b", F.max(one).over(key))
                    .where("lo < hi and a < b").select("key", "probe", "__row", "__at"),
                    "shared_segments")
    wanted = stored(shared.groupBy(F.col("__row").alias("__w_row")).agg(
        F.collect_set("__at").alias("__wanted")), "wanted_lines")
    texts = _lines(first.join(wanted, F.col("__row") == F.col("__w_row")), "__wanted").where(
        F.array_contains("__wanted", F.col("__at"))).select(
        F.col("__row").alias("t_row"), F.col("__at").alias("t_at"), "doc_id", "__line",
        _order().alias("__order"), parity(F.col("__line")).alias("__parity"))
    full = shared.join(texts, (F.col("__row") == F.col("t_row"))
                       & (F.col("__at") == F.col("t_at")))
    left = full.select("key", "probe", "__row", "doc_id", "__at", "__line", "__order",
                       "__parity")
    right = full.select(F.col("key").alias("r_key"), (1 - F.col("probe")).alias("r_probe"),
                        F.col("__line").alias("r_line"), F.col("__order").alias("r_order"),
                        F.col("__parity").alias("r_parity"))
    # Of two lines of one length both probe; the later one's probe is enough.
    likely = (F.col("r_order") < F.col("__order")) & (F.bit_count(
        F.col("__parity").bitwiseXOR(F.col("r_parity"))) <= 2 * edits) & (
        (F.col("probe") == 1) | (F.length("__line") < F.length("r_line")))
    return left.join(right, (F.col("key") == F.col("r_key"))
                     & (F.col("probe") == F.col("r_probe")) & likely
                     & alike(F.col("__line"), F.col("r_line"), edits)
                     & within(F.col("__line"), F.col("r_line"), edits), "left_semi").select(
        "__row", "doc_id", "__at").distinct()


def dedup_lines(docs: DataFrame, edits: int = EDITS, counts: bool = False,
                exact_chars: int = MIN_CHARS) -> DataFrame:
    """docs with their repeated lines removed; if asked for, n_lines and n_removed (of lines
    with exact_chars code points, both) follow."""
    if edits < 1:
        raise ValueError("edits must be positive")
    keyed = _keyed(docs)
    exact = stored(exact_repeats(keyed, exact_chars), "exact_lines")
    # The one join that shuffles the documents: they are left in buckets of its key, which the
    # later joins by the same key read as they lie.
    first = stored_by(_joined(keyed, _gone(exact, "__gone")).drop("__g_row"), "exact_deduped",
                      "__row")
    near = stored(_gone(near_repeats(first, edits), "__near"), "near_lines")
    joined = _joined(first, near).withColumn("__gone", F.when(
        F.col("__near").isNull(), F.col("__gone")).otherwise(F.array_union(
            "__near", F.coalesce("__gone", F.array().cast("array<int>")))))
    kept = F.filter(F.split("text", "\n"), lambda line, at: _stays("__gone", at))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    told = [F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda line: _long_enough(
                _trimmed(line), exact_chars))), F.lit(0)).cast("long").alias("n_lines"),
            F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")
            .alias("n_removed")] if counts else []
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`")
                           for c in docs.columns], *told)


def report(docs: DataFrame, exact_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the text that is left (null: none)."""
    out = dedup_lines(docs.select("doc_id", "text"), counts=True, exact_chars=exact_chars)
    return out.select("doc_id", "n_lines", "n_removed",
                      F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
