"""Long exact spans shared between records, by prefix-partitioned sparse suffix trees.

A suffix tree over every suffix of a corpus is split by prefixes into groups that fit into memory.
Only suffixes that begin at anchors are kept: an anchor is the k-letter window with the least hash
among w neighbouring ones (w + k - 1 = the least span length), so any span of that length holds the
same anchor in every copy, and the prefix of an anchored suffix is its k letters. Then

1. the prefixes are counted with a map-side combine and only those that stand under two different
   labels (paths) survive, as no other subtree can hold a span shared by two of them;
2. the surviving suffixes are fetched with the letters around them. Equal contexts (letters before and
   from the anchor on) are folded into one leaf with its least and greatest label;
3. the contexts of a prefix form a subtree: sorted, their neighbours' common beginnings give its internal
   nodes. A node's leaves that agree in enough letters before the anchor share a span, a repeat that
   cannot be extended to the right; each is reported with its members, once, where they first part.

The suffixes of a prefix meet in one group if there are no more than ``GROUP_CONTEXTS``. Those of more frequent ones
are folded first, with a map-side combine, so a licence header in a third of all files is one leaf. A prefix with
more contexts than that is lengthened to whole spans: its contexts are keyed by every span around the anchor, and
equal keys are equal spans, the deepest nodes there are. Repeats with the same members are folded. Pairs are only
written out in the end, from each repeat's records dealt into blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.tokens import slices
from tesserae.runtime import materialize

PREFIX = 64
#: Suffixes or contexts of one prefix that a task holds at once, and records of a repeat that a block of pairs holds, on average.
GROUP_CONTEXTS, BLOCK = 2048, 2048
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_LOW = 23  # bits of a hash that give way to the position, so one minimum yields both
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size, inverse = 1 << (n - 1).bit_length(), pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            step = np.full(size, np.uint64(base))
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"][:n], _powers["down"][:n]


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each k-letter window of ``codes``; equal windows have equal hashes wherever they stand."""
    n = len(codes)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = sums[k:] - sums[:-k]
    h *= down[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def anchors(texts: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, position in it, hash)`` of the anchors of each text of at least w + k - 1 letters.

    Together the texts must have fewer than 2 ** 23 letters, or be one text, which is cut with overlap.
    """
    size = np.array([len(t) for t in texts], dtype=np.int64)
    if size.sum() >= 1 << _LOW:
        (text,) = texts
        step, parts = 1 << (_LOW - 1), []
        for at in range(0, len(text), step):
            _, pos, h = anchors([text[at : at + step + w + k - 2]], k, w)
            parts.append((pos + at, h))
        pos, first = np.unique(np.concatenate([p for p, _ in parts]), return_index=True)
        return np.zeros(len(pos), dtype=np.int64), pos, np.concatenate([h for _, h in parts])[first]
    none = np.zeros(0, dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(codes) < w + k - 1:
        return none, none, none.astype(np.uint64)
    h = window_hashes(codes, k)
    n = len(h)
    x = (h >> np.uint64(_LOW)) << np.uint64(_LOW) | np.arange(n, dtype=np.uint64)
    rows = -(-n // w)
    padded = np.full(rows * w, ~np.uint64(0))
    padded[:n] = x
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    ends = np.cumsum(size)
    inside = np.zeros(n + 1, dtype=np.int32)  # starts of spans that lie in one text
    for begin, end in zip((ends - size).tolist(), ends.tolist()):
        if end - begin >= w + k - 1:
            inside[begin] += 1
            inside[end - (w + k - 1) + 1] -= 1
    least = least[np.cumsum(inside)[: n - w + 1] > 0]
    if not len(least):
        return none, none, none.astype(np.uint64)
    keep = np.ones(len(least), dtype=bool)
    keep[1:] = least[1:] != least[:-1]
    at = (least[keep] & np.uint64((1 << _LOW) - 1)).astype(np.int64)
    if len(at) > 2 * w:
        # In a run of one letter every window is an anchor like the next; of those with the same letters all around,
        # one in w is enough.
        same = np.zeros(len(codes) + 1, dtype=np.int64)
        like = np.append(False, codes[1:] == codes[:-1])
        like[(ends - size)[ends > ends - size]] = False  # a run ends with its text
        np.cumsum(like, out=same[1:])
        reach = w + k
        inner = (at >= reach) & (at + reach < len(codes))
        inner &= same[np.minimum(at + reach, len(codes))] - same[np.maximum(at - reach, 0) + 1] == 2 * reach - 1
        at = at[~inner | (at % w == 0)]
    text = np.searchsorted(ends, at, side="right")
    return text, at - (ends - size)[text], h[at]


def _anchor_rows(df: DataFrame, columns: list[str], span: int, k: int, schema: str, with_label: bool) -> DataFrame:
    """Anchors of each text column as ``h, _label`` or ``h, _id, place``; place is 2 * position + column number."""
    w = span - k + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for side in range(len(columns)):
                for part in slices(batch, 2 + side):
                    texts = part.column(2 + side).to_pylist()
                    has = [i for i, t in enumerate(texts) if t is not None and len(t) >= span]
                    if not has:
                        continue
                    i, pos, h = anchors([texts[i] for i in has], k, w)
                    row = np.array(has)[i]
                    h = pa.array(h.view(np.int64))
                    if with_label:
                        out = {"h": h, "_label": part.column(1).take(pa.array(row))}
                    else:
                        out = {"h": h, "_id": part.column(0).take(pa.array(row)), "place": pa.array(pos * len(columns) + side)}
                    yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def _common(a: str, b: str) -> int:
    """Length of the common beginning of two strings of about equal, small length."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def subtree_repeats(rows: list[tuple], span: int, k: int) -> Iterator[tuple[list[int], int, list[int]]]:
    """Repeats of one prefix as ``(members, letters from the anchor, letters before it that each member shares)``.

    Each row is ``(..., low, high, before, suffix)``, different and sorted by suffix, with the least and the greatest
    label of the context; ``before`` is reversed. Members of a repeat have at least ``span`` letters in common, and
    not all one label. A member's letters before the anchor are the most it shares with one of another label.
    """
    n = len(rows)
    depth = [_common(rows[i][-1], rows[i + 1][-1]) for i in range(n - 1)]
    # Internal nodes as intervals of rows, by a stack over the neighbours' common beginnings.
    stack: list[tuple[int, int]] = []
    nodes: list[tuple[int, int, int]] = []
    for i in range(n):
        d = depth[i] if i < n - 1 else -1
        low = i
        while stack and stack[-1][0] > d:
            deep, low = stack.pop()
            nodes.append((deep, low, i))
        if d >= k and (not stack or stack[-1][0] < d):
            stack.append((d, low))
    for d, low, high in nodes:
        need = span - d
        order = sorted(range(low, high + 1), key=lambda i: rows[i][-2])
        start = 0
        for j in range(1, len(order) + 1):
            if j < len(order) and (need <= 0 or len(rows[order[start]][-2]) >= need and rows[order[j]][-2][:need] == rows[order[start]][-2][:need]):
                continue
            group, start = order[start:j], j
            if len(group) < 2 or need > 0 and len(rows[group[0]][-2]) < need:
                continue
            if min(rows[i][-4] for i in group) == max(rows[i][-3] for i in group):
                continue
            # Members that part only further down are a repeat of that node.
            if not any(depth[i] == d for i in range(min(group), max(group))):
                continue
            yield group, d, _most_shared(rows, group)


def _most_shared(rows: list[tuple], group: list[int]) -> list[int]:
    """For each member, sorted by the letters before, how many of them it shares with one of another label."""

    def sweep(order: list[int]) -> list[int]:
        out, best = [], -1  # what the one before shares with the nearest of another label
        for at, i in enumerate(order):
            if at:
                j = order[at - 1]
                common = _common(rows[j][-2], rows[i][-2])
                one = rows[i][-4] == rows[i][-3] == rows[j][-4] == rows[j][-3]
                best = min(best, common) if one else common
            out.append(best)
        return out

    return [max(a, b, 0) for a, b in zip(sweep(group), sweep(group[::-1])[::-1])]


def _suffixes(records: DataFrame, id_column: str, label_column: str, text_columns: list[str], span: int, k: int, places_matter: bool, group: int) -> tuple[DataFrame, DataFrame, str]:
    """Few and many, and the type of the id: ``h, _id, place, _label, before, suffix`` of the suffixes whose prefix stands under two labels; a context once a record unless places matter."""
    kind = records.schema[id_column].dataType.simpleString()
    texts = records.select(F.col(id_column).alias("_id"), F.xxhash64(F.coalesce(F.col(label_column), F.lit(""))).alias("_label"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(text_columns)]).where("_id is not null")
    cut = texts.where(" or ".join(f"length(_t{i}) >= {span}" for i in range(len(text_columns))))
    shared = _anchor_rows(cut, text_columns, span, k, "h long, _label long", True).groupBy("h").agg(F.min("_label").alias("low"), F.max("_label").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("h", (F.col("n") > group).alias("many"))
    places = (
        _anchor_rows(cut, text_columns, span, k, f"h long, _id {kind}, place long", False)
        .join(shared, "h")
        .groupBy("_id")
        .agg(F.collect_list(F.struct("place", "h", "many")).alias("places"))  # no more than the letters of one record
    )
    joined = cut.join(places, "_id").select("_id", "_label", *[f"_t{i}" for i in range(len(text_columns))], F.col("places.place").alias("place"), F.col("places.h").alias("h"), F.col("places.many").alias("many"))
    sides, reach = len(text_columns), span - k

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                out: tuple[list, ...] = ([], [], [], [], [], [], [])
                for r in batch.slice(start, 64).to_pylist():
                    seen = set()
                    for place, h, many in zip(r["place"], r["h"], r["many"]):
                        pos, side = divmod(place, sides)
                        text = r[f"_t{side}"]
                        # A repeated id may come with other texts; a place outside of one is not its own.
                        before, suffix = text[max(0, pos - reach) : pos] if text else "", text[pos : pos + k + reach] if text else ""
                        if len(suffix) < k or len(before) + len(suffix) < span:
                            continue
                        key = (h, before, suffix)
                        if not places_matter:
                            if key in seen:
                                continue
                            seen.add(key)
                        for column, value in zip(out, (h, r["_id"], place, r["_label"], before[::-1], suffix, many)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], batch.schema.field("_id").type), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.string()), pa.array(out[5], pa.string()), pa.array(out[6], pa.bool_())], names=["h", "_id", "place", "_label", "before", "suffix", "many"])

    suffixes = joined.mapInArrow(fetch, f"h long, _id {kind}, place long, _label long, before string, suffix string, many boolean")
    return suffixes.where("not many").drop("many"), suffixes.where("many").drop("many"), kind


def _grouped(df: DataFrame, columns: list[str], schema: str, make) -> DataFrame:
    """Run ``make(prefixes, type of the second column)``, each prefix a list of its rows, sorted; a task holds one prefix and a batch at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []
        kind = None
        for batch in batches:
            kind = batch.schema.field(1).type
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                rows = rest + list(zip(*(part.column(i).to_pylist() for i in range(len(columns)))))
                end = len(rows)
                while end and rows[end - 1][0] == rows[-1][0]:
                    end -= 1
                rest = rows[end:]
                yield make(_runs(rows[:end]), kind)
        if rest:
            yield make(_runs(rest), kind)

    return df.select(*columns).repartition("h").sortWithinPartitions("h", "suffix", "before").mapInArrow(run, schema)


def _fold(rows: list[tuple]) -> tuple[list[tuple], list[list[tuple]]]:
    """Contexts ``low, high, before, suffix`` of sorted suffixes ``h, id, place, label, before, suffix``, and the suffixes of each."""
    contexts, held = [], []
    for r in rows:
        if held and held[-1][0][4:] == r[4:]:
            held[-1].append(r)
        else:
            held.append([r])
    for same in held:
        labels = [r[3] for r in same]
        contexts.append((min(labels), max(labels), same[0][4], same[0][5]))
    return contexts, held


def _small_repeats(rows: list[tuple], span: int, k: int) -> Iterator[tuple[list[tuple], int, list[int]]]:
    """Repeats among the suffixes of one prefix: suffixes, letters from the anchor on, letters before it for each."""
    contexts, held = _fold(rows)
    for c, same in zip(contexts, held):
        if c[0] != c[1]:
            yield same, len(c[3]), [len(c[2])] * len(same)
    for members, d, left in subtree_repeats(contexts, span, k):
        yield [r for i in members for r in held[i]], d, [m for i, m in zip(members, left) for _ in held[i]]


def _named(df: DataFrame) -> DataFrame:
    """The rows with the two-part name ``c1, c2`` of their context."""
    return df.withColumn("c1", F.xxhash64("h", "before", "suffix")).withColumn("c2", F.xxhash64("suffix", "h", "before"))


def _repeats(suffixes: DataFrame, span: int, k: int, group: int) -> DataFrame:
    """``n1, n2, c1, c2, left, right``: repeats among suffixes of frequent prefixes and the contexts that are their members, with the letters they share around the anchor."""
    contexts = _named(suffixes.groupBy("h", "before", "suffix").agg(F.min("_label").alias("low"), F.max("_label").alias("high")))
    sized = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most").select("h", "k")
    contexts = contexts.join(sized, "h")
    # A context under two labels is a repeat by itself.
    alone = contexts.where("low <> high").select(F.col("c1").alias("n1"), F.col("c2").alias("n2"), "c1", "c2", F.length("before").alias("left"), F.length("suffix").alias("right"))

    def make(groups: Iterable[list[tuple]], _: pa.DataType) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for rows in groups:
            for members, d, left in subtree_repeats(rows, span, k):
                n1, n2 = rows[members[0]][1] ^ d, rows[members[-1]][2] ^ (d << 20)
                for i, most in zip(members, left):
                    for column, value in zip(out, (n1, n2, rows[i][1], rows[i][2], most, d)):
                        column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["n1", "n2", "c1", "c2", "left", "right"])

    trees = _grouped(contexts.where(f"k > 1 and k <= {group}"), ["h", "c1", "c2", "low", "high", "before", "suffix"], "n1 long, n2 long, c1 long, c2 long, left long, right long", make)
    text = F.concat(F.reverse("before"), F.col("suffix"))
    each = F.explode(F.sequence(F.lit(1), F.length("text") - F.lit(span - 1))).alias("o")
    cut = contexts.where(f"k > {group}").select("c1", "c2", "low", "high", F.length("before").alias("nb"), text.alias("text")).select("c1", "c2", "low", "high", "nb", "text", each)
    letters = F.substring(F.col("text"), F.col("o"), F.lit(span))
    spans = cut.select(F.xxhash64(letters).alias("n1"), F.xxhash64(F.lit(1), letters).alias("n2"), "c1", "c2", "low", "high", (F.col("nb") - F.col("o") + 1).alias("left"), (F.col("o") - 1 - F.col("nb") + span).alias("right"))
    both = spans.groupBy("n1", "n2").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most").select("n1", "n2")
    deep = spans.join(both, ["n1", "n2"]).select("n1", "n2", "c1", "c2", "left", "right")
    return alone.unionByName(trees).unionByName(deep)


def _runs(rows: list[tuple]) -> Iterator[list[tuple]]:
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][0] != rows[start][0]:
            if i - start > 1:
                yield rows[start:i]
            start = i


def shared_span_pairs(records: DataFrame, id_column: str, label_column: str, text_columns: list[str], *, span: int = 200, k: int = PREFIX, group: int = GROUP_CONTEXTS, block: int = BLOCK) -> DataFrame:
    """``id_a, id_b``: records with different labels that share a passage of at least ``span`` letters.

    The passage may stand in any of the text columns of either record; letters are Unicode code points.
    The smaller id comes first, pairs are distinct, an id is never paired with itself. Null ids are left
    out, a null label counts as empty, null and short texts hold no passage, repeated deliveries of an id
    count once, no rows give no pairs.
    """
    few, many, kind = _suffixes(records, id_column, label_column, text_columns, span, k, False, group)

    def make(groups: Iterable[list[tuple]], ids: pa.DataType) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [])
        for rows in groups:
            known = set()
            for serial, (same, _, _) in enumerate(_small_repeats(rows, span, k)):
                people = frozenset((r[1], r[3]) for r in same)
                if people in known:
                    continue
                known.add(people)
                for i, label in people:
                    for column, value in zip(out, (rows[0][0], serial, i, label)):
                        column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], ids), pa.array(out[3], pa.int64())], names=["n1", "n2", "_id", "_label"])

    small = _grouped(few, ["h", "_id", "place", "_label", "before", "suffix"], f"n1 long, n2 long, _id {kind}, _label long", make)
    held = _named(many).select("c1", "c2", "_id", "_label").distinct()
    large = _repeats(many, span, k, group).select("n1", "n2", "c1", "c2").distinct().join(held, ["c1", "c2"]).select("n1", "n2", "_id", "_label").distinct()
    members = materialize(small.unionByName(large))
    # Of repeats with the same records one is enough.
    sums = [F.sum(F.xxhash64(F.lit(i), "_id", "_label").cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)]
    sized = members.groupBy("n1", "n2").agg(F.count(F.lit(1)).alias("n"), *sums)
    one = sized.groupBy("n", "s1", "s2").agg(F.min(F.struct("n1", "n2")).alias("m")).select("m.n1", "m.n2", "n")
    dealt = members.join(one, ["n1", "n2"]).withColumn("_n", (F.floor(F.col("n") / block) + 1).cast("int")).withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias(c)
    left = dealt.select("n1", "n2", F.col("_own").alias("_a"), every("_b"), F.col("_id").alias("id_a"), F.col("_label").alias("la"))
    right = dealt.select("n1", "n2", F.col("_own").alias("_b"), every("_a"), F.col("_id").alias("id_b"), F.col("_label").alias("lb"))
    return left.join(right, ["n1", "n2", "_a", "_b"]).where("la <> lb and id_a < id_b").select("id_a", "id_b").distinct()


def shared_coverage(records: DataFrame, id_column: str, label_column: str, text_columns: list[str], *, span: int = 200, k: int = PREFIX, group: int = GROUP_CONTEXTS) -> DataFrame:
    """``<id>, side, shared_chars``: letters of each text that stand in a passage shared with a record of another label.

    side is the text column's name. Only texts with such letters have a row; a letter in several passages
    counts once. Nulls, empties and repeats behave as in :func:`shared_span_pairs`.
    """
    sides = len(text_columns)
    few, many, kind = _suffixes(records, id_column, label_column, text_columns, span, k, True, group)

    def make(groups: Iterable[list[tuple]], ids: pa.DataType) -> pa.RecordBatch:
        reach: dict[tuple, int] = {}
        for rows in groups:
            for same, d, left in _small_repeats(rows, span, k):
                for r, most in zip(same, left):
                    key = (r[1], r[2], most)
                    reach[key] = max(reach.get(key, 0), d)
        return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in reach], ids), pa.array([p for _, p, _ in reach], pa.int64()), pa.array([m for _, _, m in reach], pa.int64()), pa.array(list(reach.values()), pa.int64())], names=["_id", "place", "left", "right"])

    small = _grouped(few, ["h", "_id", "place", "_label", "before", "suffix"], f"_id {kind}, place long, left long, right long", make)
    # A context's longest reach per depth; shallower ones that reach no further left add nothing.
    reach = _repeats(many, span, k, group).groupBy("c1", "c2", "left").agg(F.max("right").alias("right"))
    at = F.floor(F.col("place") / sides)
    large = _named(many).select("c1", "c2", "_id", "place").distinct().join(reach, ["c1", "c2"]).select("_id", "place", F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"))
    merged = small.unionByName(large).select("_id", F.pmod("place", F.lit(sides)).cast("long").alias("_side"), (at - F.col("left")).cast("long").alias("begin"), (at + F.col("right")).cast("long").alias("end")).distinct()
    order = Window.partitionBy("_id", "_side").orderBy("begin", "end")
    covered = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin"), F.coalesce(covered, F.col("begin"))))
    names = F.array(*[F.lit(c) for c in text_columns])
    total = merged.withColumn("fresh", fresh).groupBy("_id", "_side").agg(F.sum("fresh").alias("shared_chars"))
    return total.select(F.col("_id").alias(id_column), F.element_at(names, (F.col("_side") + 1).cast("int")).alias("side"), "shared_chars")
