"""Alignment of two word sequences of a row: edit operations, forced matches, fuzzy anchors and timings.

The sequences of a row are taken in Arrow batches. A row may be a whole recording:
tables of words by words are never held. Edit operations, of up to LIMIT words a
side, hold every sqrt(n)-th of the table's lines, from which a stretch of lines is
made again when it is needed; optimal matches, of any number of words, hold lines
as bits and cut the table down to where common subsequences go. Helpers are small
and know nothing of Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parlance.functions.text import score_tokens

# Fixed values of the anchor rule.
BACK, LEAST_AHEAD, AHEAD, MORE, FLOOR, SHORT_FLOOR, SHORT = 2, 12, 3, 8, 0.48, 0.86, 2
#: Words of a side that edit operations, forced matches and lists take at most; role_matches has no limit.
LIMIT = 65_535
#: Cells of a table of words by words that are held at once, stretches that a larger one is cut into, bytes of words' places that are held.
CELLS, STRETCHES, HELD = 1 << 20, 64, 64 << 20


def _codes(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    names = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    return np.array([names[w] for w in a], np.int64), np.array([names[w] for w in b], np.int64)


def _within_limit(*sides: list[str]) -> None:
    if max(map(len, sides)) > LIMIT:
        raise ValueError(f"alignments take {LIMIT} words a side at most")


def _stretches(first: np.ndarray, n: int, line: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Lines 0 to n of a table, from the last stretch of about sqrt(n) lines to the first: (number of the first line, lines).

    `line` makes line i + 1 from line i; a stretch's lines go up to the first one of the stretch behind it.
    """
    size = max(1, int(np.sqrt(n)))
    kept, now = [first], first
    for i in range(n - n % size if n % size else n - size):
        now = line(i, now)
        if (i + 1) % size == 0:
            kept.append(now)
    for k in range(len(kept) - 1, -1, -1):
        lines = [kept[k]]
        for i in range(k * size, min(n, (k + 1) * size)):
            lines.append(line(i, lines[-1]))
        yield k * size, lines
        kept[k] = first


def edit_operations(reference: list[str], hypothesis: list[str]) -> str:
    """One letter for each step of a least-cost alignment: M, S, I, D.

    From the end, a match or substitution is preferred, then a deletion, then an
    insertion. Raises ValueError beyond LIMIT words a side.
    """
    _within_limit(reference, hypothesis)
    r, h = _codes(reference, hypothesis)
    n, m = len(r), len(h)
    steps = np.arange(m + 1, dtype=np.int32)

    def line(i: int, row: np.ndarray) -> np.ndarray:
        best = row + np.int32(1)
        np.minimum(best[1:], row[:-1] + (h != r[i]), out=best[1:])
        return np.minimum.accumulate(best - steps) + steps

    out, j = [], m
    for start, lines in _stretches(steps, n, line):
        i = min(n, start + len(lines) - 1)
        while i > start:
            now, above = lines[i - start], lines[i - start - 1]
            if j and now[j] == above[j - 1] + (r[i - 1] != h[j - 1]):
                out.append("M" if r[i - 1] == h[j - 1] else "S")
                i, j = i - 1, j - 1
            elif now[j] == above[j] + 1:
                out.append("D")
                i -= 1
            else:
                out.append("I")
                j -= 1
    return "I" * j + "".join(reversed(out))


def _numbers(ones: np.ndarray) -> list[int]:
    """The ones of each row as the bits of a number."""
    return [int.from_bytes(row, "little") for row in np.packbits(ones, axis=1, bitorder="little")]


def _places(order: np.ndarray, cuts: list[int], words: np.ndarray, left: int, right: int, back: bool) -> Iterator[int]:
    """The places of each word from `left` to `right`, read backwards with `back`, as the bits of a number.

    Word w stands at order[cuts[w] : cuts[w + 1]]. Up to HELD bytes of numbers are
    held for the word's next turn, others are made anew.
    """
    held: dict[int, int] = {}
    room, width = HELD, right - left
    for word in words.tolist():
        bits = held.get(word)
        if bits is None:
            at = order[cuts[word] : cuts[word + 1]]
            at = at[at.searchsorted(left) : at.searchsorted(right)]
            at = right - 1 - at if back else at - left
            if at.size <= 4:
                bits = sum(1 << p for p in at.tolist())
            else:
                ones = np.zeros((1, width), np.uint8)
                ones[0, at] = 1
                bits = _numbers(ones)[0]
            if room >= (size := bits.bit_length() // 7 + 100):
                room -= size
                held[word] = bits
        yield bits


def _lines(places: Iterable[int], width: int, line: int) -> Iterator[int]:
    """The line before each of the words whose places are given, and the last one.

    Bit j of a line is 0 where the longest common subsequence of the words so far
    grows with the other side's word j.
    """
    full = (1 << width) - 1
    yield line
    for at in places:
        if at:
            rest = line & at
            line = ((line + rest) | (line - rest)) & full
        yield line


def _growth(lines: list[int], width: int) -> np.ndarray:
    """A row for each line, 1 where it grows."""
    size = (width + 7) // 8
    packed = np.frombuffer(b"".join(x.to_bytes(size, "little") for x in lines), np.uint8).reshape(len(lines), size)
    return 1 - np.unpackbits(packed, axis=1, count=width, bitorder="little")


def _lengths(line: int, width: int, least: int) -> np.ndarray:
    """Lengths at the width + 1 borders of a line's words."""
    return least + np.concatenate([[0], np.cumsum(_growth([line], width)[0], dtype=np.int64)])


def _optimal(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Optimal matches of x and y: (places in x, places in y, ranks from 0), in parts in the order of x.

    A stretch of x and the words of y between which every longest common
    subsequence enters and leaves it are a table. One of more than CELLS is cut
    into stretches: the lines before and behind each cut tell where the
    subsequences cross it, and no stretch needs words outside of that.
    """
    order, cuts = np.argsort(y, kind="stable"), [0, *np.cumsum(np.bincount(y)).tolist()]

    def part(start: int, stop: int, left: int, right: int, first: int, low: int, last: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        # first: the line before the stretch, low: the length at its left end; last, high: the same of what is behind, read backwards
        n, m = stop - start, right - left
        if n * m > CELLS and n > 1:
            yield from cut(start, stop, left, right, first, low, last, high)
        elif n * m:
            equal = x[start:stop, None] == y[None, left:right]
            before = list(_lines(_numbers(equal), m, first))
            behind = list(_lines(_numbers(equal[:0:-1, ::-1]), m, last))[::-1]
            total = low + m - before.pop().bit_count() + high
            i, j = np.nonzero(equal)
            before, behind = _growth(before, m), _growth(behind, m)
            rank = low + (np.cumsum(before, axis=1, dtype=np.int32) - before)[i, j]
            after = high + (np.cumsum(behind, axis=1, dtype=np.int32) - behind)[i, m - 1 - j]
            good = np.flatnonzero(rank + after + 1 == total)
            if good.size:
                yield start + i[good], left + j[good], rank[good]

    def cut(start: int, stop: int, left: int, right: int, first: int, low: int, last: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n, m = stop - start, right - left
        at = np.linspace(start, stop, min(n, STRETCHES, 2 + 4 * n * m // CELLS) + 1).astype(int).tolist()
        inner = set(at[1:-1])
        ahead = _lines(_places(order, cuts, x[start:stop], left, right, False), m, first)
        fronts = []
        for i, line in enumerate(ahead, start):
            if i in inner:
                fronts.append(line)
        total = low + m - line.bit_count() + high
        back = _lines(_places(order, cuts, x[start:stop][::-1], left, right, True), m, last)
        backs = [line for i, line in enumerate(back) if stop - i in inner]
        edges = [(left, first, low)]  # of each stretch: its leftmost place, the line before it and the length there
        ends = []  # its rightmost place, the line behind it and the length there
        for front, behind in zip(fronts, reversed(backs)):
            fore, rest = _lengths(front, m, low), _lengths(behind, m, high)[::-1]
            crossed = np.flatnonzero(fore + rest == total)
            a, b = int(crossed[0]), int(crossed[-1])
            edges.append((left + a, front >> a, int(fore[a])))
            ends.append((left + b, behind >> (m - b), int(rest[b])))
        ends.append((right, last, high))
        del fronts, backs
        for begin, end, (a, front, fore), (b, behind, rest) in zip(at, at[1:], edges, ends):
            full = (1 << (b - a)) - 1
            yield from part(begin, end, a, b, front & full, fore, behind & full, rest)

    full = (1 << len(y)) - 1
    yield from part(0, len(x), 0, len(y), full, 0, full, 0)


def optimal_codes(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """optimal_matches of words that are given as whole numbers, of any length; matches are rows of an array."""
    n, m = len(x), len(y)
    unsure_a, unsure_b = np.zeros(n, bool), np.zeros(m, bool)
    if not n or not m:
        return np.zeros((0, 2), np.int64), unsure_a, unsure_b
    names, both = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = both[:n].astype(np.int32), both[n:].astype(np.int32)
    # words that the other side lacks match nothing
    shared = (np.bincount(x, minlength=len(names)) > 0) & (np.bincount(y, minlength=len(names)) > 0)
    in_a, in_b = np.flatnonzero(shared[x]), np.flatnonzero(shared[y])
    times, first = np.zeros(min(len(in_a), len(in_b)), np.int8), np.zeros((min(len(in_a), len(in_b)), 2), np.int64)
    for i, j, rank in _optimal(x[in_a], y[in_b]):
        i, j, start = in_a[i], in_b[j], int(rank.min())
        found = np.bincount(rank - start)
        here = slice(start, start + len(found))
        was = times[here].copy()
        times[here] = np.minimum(was + found, 2)
        twice = times[rank] > 1
        unsure_a[i[twice]], unsure_b[j[twice]] = True, True
        late = first[here][(was == 1) & (found > 0)]  # the rank's first match is not the only one
        unsure_a[late[:, 0]], unsure_b[late[:, 1]] = True, True
        new = was[rank - start] == 0
        first[rank[new], 0], first[rank[new], 1] = i[new], j[new]
    return first[times == 1], unsure_a, unsure_b


def optimal_matches(a: list[str], b: list[str]) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Forced matches, and the places of `a` and of `b` whose word has several optimal matches.

    A match of equal words is optimal at its rank if some longest common
    subsequence has it there. It is forced if it is the only one of its rank; the
    words of all matches of other ranks are ambiguous. Raises ValueError beyond
    LIMIT words a side; optimal_codes takes any length.
    """
    _within_limit(a, b)
    found, unsure_a, unsure_b = optimal_codes(*_codes(a, b))
    return list(map(tuple, found.tolist())), unsure_a, unsure_b


def forced_matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal words that every longest common subsequence uses: the only ones at their rank."""
    return optimal_matches(a, b)[0]


class EditSteps:
    """A table function: the steps of the alignment of two word lists, with the places of their words (null where a side has none).

    A null list is an empty one; beyond LIMIT words a side there is one step, `too long`.
    """

    def eval(self, reference: list, hypothesis: list):
        try:
            ops = edit_operations(reference or [], hypothesis or [])
        except ValueError:
            yield 0, "too long", None, None
            return
        i = j = 0
        for step, op in enumerate(ops):
            yield step, op, i if op != "I" else None, j if op != "D" else None
            i, j = i + (op != "I"), j + (op != "D")


def register_edit_steps(spark: SparkSession, name: str = "edit_steps") -> None:
    """Makes EditSteps a table function of SQL: edit_steps(reference, hypothesis)."""
    spark.udtf.register(name, F.udtf(EditSteps, returnType="step int, op string, ref_index int, hyp_index int"))


def anchor(words: list[str], stream: list[str], cursor: int) -> tuple[int, int, float] | None:
    """(start, end, ratio) of the stream's window that is most like the words, near the cursor; None below the floor.

    Windows start from BACK before the cursor to the larger of LEAST_AHEAD and
    AHEAD * n + MORE after it, and are as long as the words, give or take one;
    ties go to the first.
    """
    n, text, floor = len(words), " ".join(words), SHORT_FLOOR if len(words) <= SHORT else FLOOR
    own, windows = Counter(text), []
    for start in range(max(0, cursor - BACK), min(len(stream), cursor + max(LEAST_AHEAD, AHEAD * n + MORE))):
        for size in (n, n - 1, n + 1):
            if size < 1 or start + size > len(stream):
                continue
            said = " ".join(stream[start : start + size])
            common = sum(min(k, said.count(c)) for c, k in own.items())
            if (bound := 2.0 * common / ((len(text) + len(said)) or 1) if text or said else 1.0) >= floor:
                windows.append((-bound, len(windows), start, size, said))
    best = None
    for bound, turn, start, size, said in sorted(windows):  # no window is more like the words than its letters in any order
        if best and (bound, turn) > best[:2]:
            break
        ratio = SequenceMatcher(None, text, said, autojunk=False).ratio()
        if ratio >= floor and (best is None or (-ratio, turn) < best[:2]):
            best = (-ratio, turn, start, start + size)
    return (best[2], best[3], -best[0]) if best else None


#: Values of a batch that are given back at once.
OUT = 50_000


def _coded(batch: pa.RecordBatch, columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Each row's word lists as whole numbers, equal for equal words of the batch; nulls are empty."""
    lists = [batch.column(c) for c in columns]
    flat = pa.concat_arrays([x.flatten() for x in lists])
    codes = flat.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    starts = np.cumsum([0, *(len(x.flatten()) for x in lists)])
    ends = [starts[k] + np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy()) for k, x in enumerate(lists)]
    for i in range(batch.num_rows):
        yield [codes[e[i - 1] if i else s : e[i]] for s, e in zip(starts, ends)]


def _rows(df: DataFrame, columns: list[str], kind: str, work, coded: bool = False) -> DataFrame:
    """`work` on each row's values of the columns; it gives tuples, which follow the row's key.

    One row's values are Python objects at a time, and what is given back goes out
    in parts. With `coded`, word lists are arrays of whole numbers.
    """
    schema = to_arrow_schema(StructType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = batch.column("key"), []
            values = _coded(batch, columns) if coded else ([batch.column(c)[i].as_py() for c in columns] for i in range(batch.num_rows))
            for i, v in enumerate(values):
                key, rows = keys[i].as_py(), iter(work(*v))
                while part := [(key, *t) for t in islice(rows, OUT)]:
                    out += part
                    if len(out) >= OUT:
                        yield _batch(out, schema)
                        out = []
            if out:
                yield _batch(out, schema)

    return df.select("key", *columns).mapInArrow(run, kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def operations(pairs: DataFrame, reference: Column, hypothesis: Column) -> DataFrame:
    """(key, ops) of pairs (key, ...)."""
    return _rows(pairs.withColumns({"r": reference, "h": hypothesis}), ["r", "h"], "key string, ops string", lambda r, h: [(edit_operations(r, h),)])


def unambiguous(pairs: DataFrame, reference: Column, hypothesis: Column) -> DataFrame:
    """(key, ref_index, hyp_index) of forced matches."""

    def work(r: np.ndarray, h: np.ndarray) -> list[tuple]:
        _within_limit(r, h)
        return list(map(tuple, optimal_codes(r, h)[0].tolist()))

    return _rows(pairs.withColumns({"r": reference, "h": hypothesis}), ["r", "h"], "key string, ref_index int, hyp_index int", work, coded=True)


def role_matches(references: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """(session_id, role, kind, ref_index, hyp_index): forced matches of each role's words with all shown words, and ambiguous shown words.

    `references` has session_id, role and words, a row for each role's whole
    channel; `hypotheses` session_id and words, as they are shown. Ambiguous rows
    have no ref_index. Sessions of any length are aligned.
    """
    kind = "key string, kind string, ref_index int, hyp_index int"

    def work(r: np.ndarray, h: np.ndarray) -> Iterator[tuple]:
        forced, _, unsure = optimal_codes(r, h)
        yield from (("forced", int(i), int(j)) for i, j in forced)
        yield from (("ambiguous", None, int(j)) for j in np.flatnonzero(unsure))

    pairs = references.join(hypotheses.withColumnRenamed("words", "h"), "session_id").select(F.to_json(F.struct("session_id", "role")).alias("key"), F.col("words").alias("r"), "h")
    found = _rows(pairs, ["r", "h"], kind, work, coded=True)
    session = references.schema["session_id"].dataType.simpleString()
    key = F.from_json("key", f"session_id {session}, role string")
    return found.select(key["session_id"].alias("session_id"), key["role"].alias("role"), "kind", F.col("ref_index").cast("int").alias("ref_index"), F.col("hyp_index").cast("int").alias("hyp_index"))


def one_role_matches(matches: DataFrame) -> DataFrame:
    """Matches (session_id, role, hyp_index, ...) whose hypothesis word one role alone claims."""
    roles = matches.groupBy("session_id", "hyp_index").agg(F.count_distinct("role").alias("n")).where("n = 1").select("session_id", "hyp_index")
    return matches.join(roles, ["session_id", "hyp_index"], "left_semi")


def one_role_words(matches: DataFrame) -> DataFrame:
    """(session_id, hyp_index, class, role, ref_index) of shown words that some role's alignment claims (see role_matches).

    A word belongs to the one role that has a forced match for it, if no other
    role has an ambiguous one: exact_unambiguous. Words that several roles claim
    are cross_role_ambiguous, the others within_role_ambiguous.
    """
    forced, unsure = F.col("kind") == "forced", F.col("kind") == "ambiguous"
    each = matches.where("hyp_index is not null").groupBy("session_id", "hyp_index").agg(
        F.collect_set(F.when(forced, F.col("role"))).alias("owners"),
        F.collect_set(F.when(unsure, F.col("role"))).alias("others"),
        F.min(F.when(forced, F.col("ref_index"))).alias("ref_index"),
    )
    alone = (F.size("owners") == 1) & (F.size(F.array_except("others", "owners")) == 0)
    shared = (F.size("owners") > 0) | (F.size("others") > 1)
    kind = F.when(alone, "exact_unambiguous").when(shared, "cross_role_ambiguous").otherwise("within_role_ambiguous")
    return each.select("session_id", "hyp_index", kind.alias("class"), F.when(alone, F.col("owners")[0]).alias("role"), F.when(alone, F.col("ref_index")).alias("ref_index"))


def overlap_ambiguous(references: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """(session_id, hyp_index): shown words whose identity hangs on the order of words spoken at once.

    `references` has session_id, place, word and overlaps (spoken while another
    role spoke) in linear order; `hypotheses` session_id and words. A shown word
    counts if its forced match overlaps, or if it is ambiguous and is a word that
    some overlapping one has too. Sessions without overlapping words have none.
    """
    lined = references.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"), F.max("overlaps").alias("any"))
    lined = lined.where("any").select("session_id", F.lit("").alias("role"), F.transform("w", lambda x: x["word"]).alias("words"))
    found = role_matches(lined, hypotheses)
    over = references.where("overlaps").select("session_id", (F.col("place")).cast("int").alias("ref_index"), "word")
    by_match = found.where("kind = 'forced'").join(over, ["session_id", "ref_index"]).select("session_id", "hyp_index")
    shown = hypotheses.select("session_id", F.posexplode("words").alias("hyp_index", "word"))
    unsure = found.where("kind = 'ambiguous'").select("session_id", "hyp_index").join(shown, ["session_id", "hyp_index"])
    by_word = unsure.join(over.select("session_id", "word").distinct(), ["session_id", "word"]).select("session_id", "hyp_index")
    return by_match.union(by_word).distinct()


def anchors(rows: DataFrame, words: Column, stream: Column, cursor: Column) -> DataFrame:
    """(key, from_word, to_word, ratio) of rows that find an anchor in their stream."""
    kind = "key string, from_word int, to_word int, ratio double"
    first = F.greatest(F.col("c") - BACK, F.lit(0))
    near = F.slice("s", first + 1, F.col("c") - first + F.greatest(F.lit(LEAST_AHEAD), AHEAD * F.size("w") + MORE) + F.size("w") + 1)
    each = rows.withColumns({"w": words, "s": stream, "c": cursor.cast("int")})

    def work(w: list[str], s: list[str], c: int, f: int) -> list[tuple]:
        found = anchor(w, s, c - f)
        return [(found[0] + f, found[1] + f, round(found[2], 6))] if found else []

    return _rows(each.withColumns({"n": near, "f": first}), ["w", "n", "c", "f"], kind, work)


def allocated(rows: DataFrame, found: DataFrame, n_words: DataFrame) -> DataFrame:
    """(session_id, position, from_word, to_word): a session's words shared out over its rows.

    Rows with anchors begin at theirs, if anchors rise; rows without begin at an
    even share of the gap between those around them. A session with fewer than
    max(2, a third of its rows) anchors is shared out by its rows' own words.
    """
    from pyspark.sql import Window

    session = Window.partitionBy("session_id")
    order = session.orderBy("position")
    each = rows.join(found, ["session_id", "position"], "left").join(n_words, "session_id")
    rising = F.col("from_word") > F.coalesce(F.max("from_word").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    each = each.withColumn("_n", F.row_number().over(order)).withColumn("_start", F.when(rising, F.col("from_word")))
    each = each.withColumn("_start", F.when(F.col("_n") == 1, 0).otherwise(F.col("_start")))
    enough = F.count("from_word").over(session) >= F.greatest(F.lit(2), F.expr("count(1) over (partition by session_id) div 3"))
    low = F.last(F.when(F.col("_start").isNotNull(), F.struct("_start", "_n")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first(F.when(F.col("_start").isNotNull(), F.struct("_start", "_n")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    each = each.withColumn("_enough", enough).withColumn("_low", low).withColumn("_high", high).withColumn("_rows", F.count(F.lit(1)).over(session))
    end_at, end_n = F.coalesce("_high._start", "total"), F.coalesce("_high._n", F.col("_rows") + 1)
    routed = F.col("_low._start") + F.floor((end_at - F.col("_low._start")) * (F.col("_n") - F.col("_low._n")) / (end_n - F.col("_low._n")))
    before = F.coalesce(F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum("own").over(session)
    share = F.floor(F.col("total") * before / F.when(own > 0, own))
    each = each.withColumn("from_", F.when(F.col("_enough"), routed).otherwise(F.coalesce(share, F.lit(0))).cast("long"))
    to = F.coalesce(F.lead("from_").over(order), F.col("total")).cast("long")
    return each.select("session_id", "position", F.col("from_").alias("from_word"), to.alias("to_word"))


def occurrences(rows: DataFrame, *phrases: list[str]) -> DataFrame:
    """(session_id, at, first_row, last_row) of each place of the phrases in a session's words; rows are (session_id, position, words).

    A row's words are followed by the next rows' first ones, as many as a phrase
    may need, so rows are sorted and not words.
    """
    from pyspark.sql import Window

    order, ahead = Window.partitionBy("session_id").orderBy("position"), max(map(len, phrases)) - 1
    each = rows.where(F.size("words") > 0).withColumn("_before", F.coalesce(F.sum(F.size("words")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = each.withColumn("_own", F.transform("words", lambda w: F.struct(F.col("position"), w.alias("word"))))
    later = F.flatten(F.collect_list(F.slice("_own", 1, ahead)).over(order.rowsBetween(1, ahead))) if ahead else F.slice("_own", 1, 0)
    each = each.withColumn("_later", later)

    def places(said: Column, phrase: list[str]) -> Column:
        here = lambda i, k: F.try_element_at(said, (i + k).cast("int"))
        hit = lambda i: reduce(lambda a, b: a & b, (F.coalesce(here(i, k)["word"] == w, F.lit(False)) for k, w in enumerate(phrase)))
        place = lambda i: F.struct((F.col("_before") + i - 1).alias("at"), here(i, len(phrase) - 1)["position"].alias("last_row"))
        return F.transform(F.filter(F.sequence(F.lit(1), F.size("words")), hit), place)

    # the words are a variable of a lambda, so that they are put together once for each row
    found = F.transform(F.array(F.concat("_own", F.slice("_later", 1, ahead))), lambda said: F.concat(*(places(said, p) for p in phrases)))[0]
    each = each.select("session_id", F.col("position").alias("first_row"), F.explode(found).alias("x"))
    return each.select("session_id", "x.at", "first_row", "x.last_row")


def valid_timing(words: Column, starts: Column, ends: Column) -> Column:
    """Whether each word has one finite span that ends no sooner than it starts, and starts never go back."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    one = (F.size(words) == F.size(starts)) & (F.size(words) == F.size(ends))
    spans = F.forall(F.zip_with(starts, ends, lambda a, b: finite(a) & finite(b) & (b >= a)), lambda x: F.coalesce(x, F.lit(False)))
    rises = F.forall(F.zip_with(F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))), F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), lambda a, b: b >= a), lambda x: F.coalesce(x, F.lit(False)))
    return one & spans & rises


def folded_punctuation(tokens: Column) -> Column:
    """Tokens of punctuation alone are put behind the word before them; those at the start stand alone."""
    is_mark = lambda t: t.rlike(r"^[^\p{L}\p{N}]+$")

    def add(done: Column, t: Column) -> Column:
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), t)))
        return F.when(is_mark(t) & (F.size(done) > 0), joined).otherwise(F.concat(done, F.array(t)))

    return F.aggregate(tokens, F.array().cast("array<string>"), add)


def reference_words(refs: DataFrame, ambiguous: Column) -> DataFrame:
    """(session_id, place, i, word, ambiguous): the reference's words in the order of their intervals."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("session_id").orderBy("ref_start", "ref_end", "ref_role", "ordinal")) - 1
    each = refs.withColumn("place", place).withColumn("ambiguous", ambiguous)
    return each.select("session_id", "place", "ambiguous", F.posexplode(score_tokens(F.col("ref_text"))).alias("i", "word"))


def ownership(judged: DataFrame) -> DataFrame:
    """(session_id, speaker_id, doctor, patient, unowned, best): rows by expected role, and those of the more common one."""
    role = F.col("expected_role")
    d, p = F.count_if(role == "DOCTOR"), F.count_if(role == "PATIENT")
    return judged.groupBy("session_id", "speaker_id").agg(d.alias("doctor"), p.alias("patient"), F.count_if(role.isNull()).alias("unowned"), F.greatest(d, p).alias("best"))
