"""Near-duplicate lines: a segment-partition edit join over all lines of a corpus.

A line of L code points is cut into edits+1 segments. Two lines within `edits` edits agree in one whole
segment at least (pigeonhole), at a place that the difference of their lengths bounds. So every line is
indexed under its own segments, keyed by (ordinal, length, segment), and probes for its own length and up to
`edits` less with the few substrings that a match could start from (the multi-match-aware ranges of
PassJoin, Li et al., 2011). Keys are 64-bit rolling hashes, packed by bucket before they are shuffled. What
shares a key and has near-equal letter counts is verified with banded bit-parallel edit distance, many
pairs at a time.

How many edits two lines may be apart grows with the shorter one: one for every `every` code points, up to
`edits`. So there is a join for each number of edits, of the lines of its lengths; below `every` code points no
edit is allowed, and the one segment is the whole line.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.common import block_links, connected_components, durable, forest, free_names, stars, tasks

#: Edits up to which lines are alike, and the code points of the shorter line that allow for one edit each.
EDITS, EVERY = 2, 24
#: Candidate line ids that are broadcast at most (16 MB); beyond it they are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Bytes of text that a task hashes, or compares the groups of, at a time, and those whose arrays stay in a core's cache.
_SLICE, _HASHED = 2_000_000, 250_000
#: Bytes that a line counts for at least where groups are compared, as short ones make more pairs a byte.
_LEAST = 400
#: A packed key: its low 31 bits and whether it is of the line's own segment; the line; its letter counts. The
#: bucket tells 2^31 keys apart further, and buckets grow with the corpus.
_ENTRY = np.dtype([("key", "<u4"), ("h1", "<i8"), ("counts", "<u8")])
#: Members of a key that one task compares; larger groups are cut by length and dealt out by pairs of blocks.
BLOCK, LENGTHS = 256, 8
#: Fixed value: what a line is stripped of before it is compared.
BLANKS = " \t\r\x0b\x0c 　"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2^64 and their inverses, n of each."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for base in (_BASE, inverse):
        power = np.full(n, base, np.uint64)
        power[:1] = 1
        out.append(np.multiply.accumulate(power))
    return out[0], out[1]


#: The powers that most slices need, held once per worker.
_usual_powers = lru_cache(1)(powers)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _looked_up(work):
    """work, a function of code points one by one, with the basic plane's values from a table."""
    table = work(np.arange(65536, dtype=np.uint32))

    def of(points: np.ndarray) -> np.ndarray:
        return table.take(points) if not len(points) or points.max() < 65536 else work(points)

    return of


point_hashes = _looked_up(lambda points: mix(points.astype(np.uint64) + np.uint64(1)))


def code_points(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All lines' code points, and the length of each line."""
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), pa.scalar("", lines.type))[0].as_py()
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)


#: For each code point a one in one of sixteen 4-bit lanes; sums of them may carry, see near_counts.
letter_counts = _looked_up(lambda points: np.uint64(1) << ((points.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(13) & np.uint64(15)) << np.uint64(2)))


def line_counts(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Letter counts of each line; none is empty."""
    return np.add.reduceat(letter_counts(points), np.cumsum(lengths) - lengths)


def runs_of(lines: pa.Array, size: int):
    """(low, high) of runs of lines of at most `size` bytes, but for longer lines, which are runs by themselves."""
    total = np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(total):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + size, "right")))
        yield low, high
        low = high


_LANES = np.arange(65536, dtype=np.int64)
_LANE_SUM = sum(abs(((_LANES >> s) & 15) - 8) for s in (0, 4, 8, 12)).astype(np.uint8)
_BIAS = np.uint64(0x8888888888888888)


def near_counts(a: np.ndarray, b: np.ndarray, edits: int | np.ndarray) -> np.ndarray:
    """Whether letter counts may differ by so few edits (never false for lines that do).

    The difference of two sums is the lanes' differences in balanced base 16; where these are small, adding
    eight to each lane shows them without carries.
    """
    parts = (a - b + _BIAS).view("<u2").reshape(-1, 4)
    return _LANE_SUM[parts].sum(axis=1, dtype=np.int64) <= 2 * edits


def probe_plan(edits: int) -> list[tuple[int, int, int]]:
    """(segment, length difference, shift of the start) of every substring that a line probes with.

    The first entries with difference 0 and shift 0 are the line's own segments.
    """
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            out += [(i, less, shift) for shift in range(low, high + 1)]
    return out


def segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of lines of these lengths: as even as can be, the longer ones last."""
    n = edits + 1
    each = length // n
    longer = length - each * n
    return i * each + np.maximum(0, i - (n - longer)), each + (i >= n - longer)


def segment_keys(points: np.ndarray, lengths: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, own) for all keys of these lines; own: the key is of the line's own segment."""
    starts = np.cumsum(lengths) - lengths
    power, inverse = _usual_powers(_HASHED + 1) if len(points) <= _HASHED else powers(len(points) + 1)
    summed = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(point_hashes(points) * power[: len(points)], out=summed[1:])
    i, less, shift = (x[:, None] for x in np.array(probe_plan(edits)).T)  # a row a probe, a column a line
    other = lengths - less
    at, n = segment(other, i, edits)
    at = at + shift
    fits = (at >= 0) & (at + n <= lengths) & (n > 0)
    low, high = (starts + at)[fits], (starts + at + n)[fits]
    salt = (other.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + i.astype(np.uint64))[fits]
    keys = mix((summed[high] - summed[low]) * inverse[low] + salt)
    return np.broadcast_to(np.arange(len(lengths)), fits.shape)[fits], keys, np.broadcast_to((less == 0) & (shift == 0), fits.shape)[fits]


def within_edits(left: list[str], right: list[str], edits: int) -> np.ndarray:
    """Whether each left line is within `edits` edits of its right line.

    Per pair and error count one small integer holds the band's diagonals as bits; all pairs step through
    their texts together, so that the cost is a few vector operations a character.
    """
    n, band = len(left), 2 * edits + 1
    out = np.zeros(n, bool)
    size = np.array([[len(a), len(b)] for a, b in zip(left, right)], np.int64).reshape(-1, 2)
    order = np.argsort(size[:, 1], kind="stable")
    order = order[np.abs(size[order, 0] - size[order, 1]) <= edits]
    at = 0
    while at < len(order):  # so many at a time that the comparison bits stay within some MB
        stop = at + 1
        while stop < len(order) and (stop - at + 1) * (size[order[stop], 1] + 1) <= 4_000_000:
            stop += 1
        rows, at = order[at:stop], stop
        longest = int(size[rows, 1].max())
        text = np.zeros((len(rows), longest), np.uint32)
        pattern = np.full((len(rows), longest + 2 * edits), 0xFFFFFFFF, np.uint32)
        for k, r in enumerate(rows):
            text[k, : size[r, 1]] = np.frombuffer(right[r].encode("utf-32-le", "surrogatepass"), "<u4")
            got = np.frombuffer(left[r].encode("utf-32-le", "surrogatepass"), "<u4")
            got = got[: longest + edits]
            pattern[k, edits : edits + len(got)] = got
        equal = np.zeros((longest, len(rows)), np.uint16)
        for d in range(band):
            equal |= (pattern[:, d : d + longest] == text).T.astype(np.uint16) << np.uint16(d)
        full = np.uint16((1 << band) - 1)
        state = [np.full(len(rows), ((2 << e) - 1) << edits, np.uint16) & full for e in range(edits + 1)]
        finish = size[rows, 1]
        goal = np.uint16(1) << (size[rows, 0] - size[rows, 1] + edits).astype(np.uint16)
        for j in range(longest + 1):
            done = finish == j
            if done.any():
                out[rows[done]] = (state[-1][done] & goal[done]) != 0
            if j == longest:
                break
            new = [state[0] & equal[j]]
            for e in range(1, edits + 1):
                new.append(((state[e] & equal[j]) | state[e - 1] | (state[e - 1] >> np.uint16(1)) | (new[e - 1] << np.uint16(1))) & full)
            state = new
    return out


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, pos, line, h1, h2) of every line with more than blanks. k1, k2: the row that it is in."""
    keyed = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text")).where("text is not null")
    lines = keyed.select("k1", "k2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # few lines have blanks at their ends, and looking costs less than trimming
    ends = reduce(or_, [F.startswith("line", F.lit(c)) | F.endswith("line", F.lit(c)) for c in BLANKS])
    lines = lines.withColumn("line", F.when(ends, F.trim("line", F.lit(BLANKS))).otherwise(F.col("line"))).where("line <> ''")
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})


def row_key(id_col: str, text_col: str):
    """Columns k1, k2 that tell rows apart; rows with the same id and text are one."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k1"), F.xxhash64(F.col(id_col).isNull(), F.col(text_col)).alias("k2")


def _linked(left, right, a, b, apart):
    """Stars of the links among pairs of lines; left, right: (ids, texts)."""
    good = np.zeros(len(a), bool)
    for e in np.unique(apart):
        of = np.flatnonzero(apart == e)
        for k in range(0, len(of), 20_000):
            part = of[k : k + 20_000]
            good[part] = within_edits([left[1][i] for i in a[part]], [right[1][i] for i in b[part]], int(e))
    return forest(left[0][a[good]], right[0][b[good]])


def _read(rows):
    """(ids, texts), lengths and letter counts."""
    points, lengths = code_points(rows.column("line"))
    return (rows.column("h1").to_numpy(zero_copy_only=False), rows.column("line").to_pylist()), lengths, line_counts(points, lengths)


def compare_blocks(left, right, same):
    """Stars of the links between two blocks of lines."""
    apart = int(left.column("apart")[0].as_py())
    (first, length, bag), (second, lengths, bags) = _read(left), _read(right)
    found_a, found_b = [], []
    for i in range(len(length)):
        rest = np.arange(i + 1 if same else 0, len(lengths))
        rest = rest[(np.abs(lengths[rest] - length[i]) <= apart) & near_counts(np.full(len(rest), bag[i]), bags[rest], apart)] if len(rest) else rest
        found_a.append(np.full(len(rest), i))
        found_b.append(rest)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    return _linked(first, second, a, b, np.full(len(a), apart))


def group_links(batches):
    """Links within groups that come one after the other, many groups at a time."""

    def closed(held):
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key, apart = rows.column("key").to_numpy(), rows.column("apart").to_numpy().astype(np.int64)
        lines, lengths, bags = _read(rows)
        found_a, found_b, at, step = [], [], np.arange(len(key)), 1
        while True:
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            hit = at[(np.abs(lengths[at] - lengths[at + step]) <= apart[at]) & near_counts(bags[at], bags[at + step], apart[at])]
            found_a.append(hit)
            found_b.append(hit + step)
            step += 1
        if found_a:
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in _linked(lines, lines, a, b, apart[a])], names=["a", "b"])

    held, size = [], 0  # whole groups, and the one that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        total = np.r_[0, np.cumsum(np.maximum(pc.binary_length(batch.column("line")).to_numpy(zero_copy_only=False), _LEAST), dtype=np.int64)]
        low = 0
        for cut in cuts[:-1]:
            ends = cut > 0 or held and held[-1].column("key")[-1].as_py() != key[0]
            if ends and size + total[cut] - total[low] >= _SLICE:
                yield from closed([*held, batch.slice(low, cut - low)])
                held, size, low = [], 0, cut
        held.append(batch.slice(low))
        size += int(total[-1] - total[low])
    if held:
        yield from closed(held)


def line_links(lines: DataFrame, edits: int = EDITS, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """Links (a, b: h1 of the lines), stars by partition, that join all different lines within the edits that their lengths allow."""
    fuzzy = lines.where(F.char_length("line") >= max(every, 2)).select("h1", "line")
    buckets = 4 * tasks(lines)

    def keyed(batches):
        """Packed keys by bucket, which tells the number of edits too."""
        for batch in batches:
            fresh, first = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
            text = batch.column(1).take(pa.array(first))
            for low, high in runs_of(text, _SLICE):
                part = text.slice(low, high - low)
                length = pc.utf8_length(part).to_numpy(zero_copy_only=False)
                for e in range(1, edits + 1):
                    mine = np.flatnonzero((length >= e * every) & ((length < (e + 1) * every + e) | (e == edits)) & (length > e))
                    if not len(mine):
                        continue
                    chosen, found = part.take(pa.array(mine)), []
                    for first, last in runs_of(chosen, _HASHED):
                        points, lengths = code_points(chosen.slice(first, last - first))
                        row, key, own = segment_keys(points, lengths, e)
                        found.append((row + first, key, own, line_counts(points, lengths)))
                    row, key, own, counts = (np.concatenate(x) for x in zip(*found))
                    bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) * edits + e - 1
                    order = np.argsort(bucket.astype(np.uint16) if buckets * edits <= 65536 else bucket, kind="stable")
                    packed = np.empty(len(order), _ENTRY)
                    packed["key"] = (key << np.uint64(1) | own.astype(np.uint64)).astype(np.uint32)
                    packed["h1"], packed["counts"] = fresh[low:high][mine][row], counts[row]
                    packed, bucket = packed[order], bucket[order]
                    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                    blobs = [packed[a:b].tobytes() for a, b in zip(start, np.r_[start[1:], len(order)])]
                    yield pa.record_batch([pa.array(bucket[start], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def shared(batches):
        """(key, id) of the lines that share a key and could be alike."""
        held, place = [], []
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                held.append(np.frombuffer(blob, _ENTRY))
                place.append(np.full(len(held[-1]), bucket, np.int64))
        if not held:
            return
        rows = np.concatenate(held)
        held.clear()
        key, own = np.concatenate(place) << 31 | (rows["key"] >> 1).astype(np.int64), (rows["key"] & 1).astype(np.int64)
        # most keys are of one line: only the others are put in order of ids too
        order = np.argsort(key)
        alike = key[order[1:]] == key[order[:-1]]
        order = order[np.r_[alike, False] | np.r_[False, alike]] if len(order) > 1 else order[:0]
        if not len(order):
            return
        order = order[np.lexsort((rows["h1"][order], key[order]))]
        key, own, ids, counts = key[order], own[order], rows["h1"][order], rows["counts"][order]
        del rows
        new = np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])]
        own = np.maximum.reduceat(own, np.flatnonzero(new))
        key, ids, counts = key[new], ids[new], counts[new]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        indexed = np.maximum.reduceat(own, starts)
        live = (sizes > 1) & (indexed == 1)
        keep = np.zeros(len(key), bool)
        small = np.repeat(live & (sizes <= 64), sizes)
        at, step = np.flatnonzero(small), 1
        while True:
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            hit = at[near_counts(counts[at], counts[at + step], (key[at] >> 31) % edits + 1)]
            keep[hit] = keep[hit + step] = True
            step += 1
        for start, n in zip(starts[live & (sizes > 64)], sizes[live & (sizes > 64)]):
            if n > 20_000:
                keep[start : start + n] = True
                continue
            group = counts[start : start + n]
            for i in range(n - 1):
                if not keep[start + i] or not keep[start + i + 1 : start + n].all():
                    hit = np.flatnonzero(near_counts(np.broadcast_to(group[i], n - i - 1).copy(), group[i + 1 :], int(key[start] >> 31) % edits + 1))
                    keep[start + i] |= len(hit) > 0
                    keep[start + i + 1 + hit] = True
        for i in range(0, int(keep.sum()), 100_000):
            part = np.flatnonzero(keep)[i : i + 100_000]
            yield pa.record_batch([pa.array(key[part]), pa.array(ids[part])], names=["key", "h1"])

    entries = fuzzy.mapInArrow(keyed, "bucket int, blob binary").repartition(tasks(lines), "bucket")
    members = durable(entries.mapInArrow(shared, "key long, h1 long"))
    wanted = members.select("h1").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = fuzzy.join(wanted, "h1", "left_semi").groupBy("h1").agg(F.min("line").alias("line"))
    members = members.withColumn("apart", (F.shiftright("key", 31) % edits + 1).cast("int"))

    # groups over a block are told by their keys before any task reads one
    large = durable(members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block))
    groups = members.join(texts, "h1").select("key", "apart", "h1", "line")
    if large.isEmpty():
        return _in_groups(groups, group_links)
    keys = large.select("key")
    keys = F.broadcast(keys) if large.count() <= BROADCAST_IDS else keys
    small = _in_groups(groups.join(keys, "key", "left_anti"), group_links)
    # a large group is cut into cells of near-equal lengths; a line that is near the next smaller cell is in it too
    length = F.char_length("line")
    cell = F.floor(length / LENGTHS)
    cells = groups.join(keys, "key").withColumn("cell", F.explode(F.when(length % LENGTHS < edits, F.array(cell, cell - 1)).otherwise(F.array(cell))))
    cells = durable(cells.select(F.xxhash64("key", "cell").alias("key"), "apart", "h1", "line"))
    parts = cells.groupBy("key").agg(F.ceil(F.count("*") / block).alias("parts"))
    placed = cells.join(parts, "key").select("key", (F.pmod(F.xxhash64("h1"), F.col("parts")) * block).alias("nth"), F.lit(0).cast("long").alias("by"), "apart", "h1", "line")
    return small.unionByName(block_links(placed, compare_blocks, block, fold=True))


def _in_groups(groups: DataFrame, work) -> DataFrame:
    return groups.repartition(tasks(groups), "key").sortWithinPartitions("key", "h1").mapInArrow(lambda batches: stars(work(batches)), "a long, b long")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, every: int = EVERY) -> DataFrame:
    """(k1, k2, removed): per row of docs with repeats, the positions of its lines that are alike an earlier one.

    Lines are alike if a chain of lines joins them, each within the edits that the shorter of two allows; of each such class the line that
    comes first by (id, row, position) stays. Rows and keys as in row_key.
    """
    lines = lines_of(docs, id_col, text_col)
    here = F.struct("k1", "k2", "pos")
    firsts = durable(lines.groupBy("h1", "h2").agg(F.min(here).alias("f"), F.count("*").alias("n")).select("h1", "h2", "f.k1", "f.k2", "f.pos", "n"))
    classes = connected_components(line_links(lines, edits, every), folded=True)
    members = classes.unionByName(classes.select(F.col("component").alias("id"), "component").distinct())
    firsts = firsts.select("h1", "h2", here.alias("first"), "n")
    near = firsts.join(members, F.col("h1") == F.col("id"))
    heads = near.groupBy("component").agg(F.min("first").alias("head"))
    near = near.join(heads, "component").select("h1", "h2", F.col("head").alias("stays"))
    stays = firsts.where("n > 1").select("h1", "h2", "first").join(near, ["h1", "h2"], "full_outer").select("h1", "h2", F.coalesce("stays", "first").alias("stays"))
    gone = lines.select("k1", "k2", "pos", "h1", "h2").join(stays, ["h1", "h2"]).where(here != F.col("stays"))
    return gone.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, every: int = EVERY, report: bool = False) -> DataFrame:
    """docs with text_col cut to the lines that are no repeats; report: with n_lines and removed (positions) too.

    Lines end at newline characters and are compared without blanks at their ends; blank lines stay. Of lines that are alike over the
    whole corpus the first by id stays (null ids first), later ones go, within one document as well. Null
    and empty texts stay as they are. Rows that repeat an id and text are cut alike, as if they were one
    row. Other columns stay as they are; a column called n_lines or removed is replaced if report is set.
    No rows: no rows.
    """
    gone = repeated_lines(docs, id_col, text_col, edits, every)
    n1, n2, cut = free_names(docs, "k1", "k2", "gone")
    gone = gone.select(F.col("k1").alias(n1), F.col("k2").alias(n2), F.col("removed").alias(cut))
    names = [c for c in docs.columns if not (report and c.lower() in ("n_lines", "removed"))]
    k1, k2 = row_key(id_col, text_col)
    joined = docs.select(*(F.col(f"`{c}`") for c in names), k1.alias(n1), k2.alias(n2)).join(gone, [n1, n2], "left")
    split = F.split(F.col(text_col), "\n", -1)
    # the lines are bound once and the places that stay looked up in them: as many steps as there are lines
    staying = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cut)
    kept = F.get(F.transform(F.array(split), lambda lines: F.array_join(F.transform(staying(lines), lambda i: F.get(lines, i)), "\n")), F.lit(0))
    text = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(kept)
    out = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names]
    more = [F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"), F.coalesce(cut, F.array().cast("array<int>")).alias("removed")]
    return joined.select(*out, *(more if report else []))
