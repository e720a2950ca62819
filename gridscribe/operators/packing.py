"""Greedy window packing: folds over ordered rows with the memory of one window.

Rows are dealt by (table, block) and sorted inside their partitions; a fold streams through them, and starts anew where the key
changes. Where a row's size doesn't depend on its window (the plain strategy) a table is split into chunks that are packed
at the same time. Sizes are those of functions.text; a window never exceeds its limit, for a row that is too wide for one window is
split by columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridscribe.functions.text import WINDOW

PASSAGES = "table_id string, block_id int, window_id int, passage string, size int, rows array<int>, cols array<array<int>>, special_tokens array<string>"


def folded(rows: DataFrame, fold: Callable[[tuple], object], schema: str = PASSAGES) -> DataFrame:
    """fold(first row) gives an object with add(row) -> outputs and end() -> outputs, one per (table_id, block_id)."""
    sorted_rows = rows.repartition("table_id", "block_id").sortWithinPartitions("table_id", "block_id", "ord")
    names = [x.strip().split(" ")[0] for x in schema.replace("array<array<int>>", "x").split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, key = None, None
        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False):
                if (row.table_id, row.block_id) != key:
                    if state is not None:
                        out += state.end()
                    state, key = fold(row), (row.table_id, row.block_id)
                out += state.add(row)
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame(state.end(), columns=names)

    return sorted_rows.mapInPandas(run, schema)


def next_starts(sizes: np.ndarray, room: int) -> np.ndarray:
    """For each row as the first of a window, the first row of the next one; a row above the room is a window of its own."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(sizes))
    return np.maximum(at + 1, np.searchsorted(total, total[:-1] + room, "right") - 1)


def passage_of(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """What a run of rows does to the window that is open before it: (tokens in the open window after, windows closed).

    By the tokens in the open window before, 0 (nothing is open) to room + 1 (more than the room: full).
    """
    follow = next_starts(sizes, room)
    total = np.concatenate([[0], np.cumsum(sizes)])
    # of a chain that begins a window at row i: the start of its last window, and how many windows it closes
    last, closed = np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
    for i in range(len(sizes) - 1, -1, -1):
        if follow[i] < len(sizes):
            last[i], closed[i] = last[follow[i]], closed[follow[i]] + 1
    used = np.arange(room + 2)
    first = np.searchsorted(total, room - used, "right") - 1  # rows that still fit
    first[0] = 0
    first = np.maximum(first, 0)
    out, shut = np.empty(room + 2, np.int64), np.empty(room + 2, np.int64)
    for u in range(room + 2):
        i = int(first[u])
        if i >= len(sizes):
            out[u], shut[u] = u + total[-1], 0
        else:
            out[u], shut[u] = total[-1] - total[last[i]], closed[i] + (u > 0)
    return np.minimum(out, room + 1), shut


def _runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Whole runs of equal keys of a sorted stream of frames."""
    held: list[pd.DataFrame] = []
    key = None
    for frame in frames:
        if not len(frame):
            continue
        new = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
        new[0] = True
        cuts = [*np.flatnonzero(new).tolist(), len(frame)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = tuple(frame[keys].iloc[a])
            if own != key and held:
                yield key, pd.concat(held, ignore_index=True)
                held = []
            key = own
            held.append(frame.iloc[a:b])
    if held:
        yield key, pd.concat(held, ignore_index=True)


CHUNK = ["table_id", "block_id", "chunk"]


def windows(rows: DataFrame, limit: int = WINDOW, chunk_rows: int = 1 << 16) -> DataFrame:
    """(table_id, block_id, row, window_id) of rows (ord, size, and fixed: what every window spends beside its rows), by next-fit.

    A table is as many tasks as it has chunks of rows. What a chunk does to an open window is one small table by its fill;
    these tables are followed in order (one short row a chunk), which tells each chunk its first fill and window, and then
    all chunks number their rows at the same time.
    """
    from gridscribe.plans.staging import written

    small = rows.select("table_id", "block_id", "row", "ord", "size", "fixed").withColumn("chunk", F.floor(F.col("ord") / chunk_rows).cast("int"))
    dealt = written(small, "sizes").repartition(*CHUNK).sortWithinPartitions(*CHUNK, "ord")

    def through(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, own in _runs(frames, CHUNK):
            after, closed = passage_of(own["size"].to_numpy(np.int64), limit - int(own["fixed"].iloc[0]))
            yield pd.DataFrame([(*key, key[2], after.tolist(), closed.tolist())], columns=[*CHUNK, "ord", "after", "closed"])

    class Followed:
        def __init__(self, row):
            self.used, self.window = 0, 0

        def add(self, row) -> list[tuple]:
            out = [(row.table_id, row.block_id, row.chunk, self.used, self.window)]
            self.window += int(row.closed[self.used])
            self.used = int(row.after[self.used])
            return out

        def end(self) -> list[tuple]:
            return []

    tables = dealt.mapInPandas(through, "table_id string, block_id int, chunk int, ord int, after array<long>, closed array<long>")
    entries = written(folded(tables, Followed, "table_id string, block_id int, chunk int, used int, window int"), "entries")

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, own in _runs(frames, CHUNK):
            sizes, room, used = own["size"].to_numpy(np.int64), limit - int(own["fixed"].iloc[0]), int(own["used"].iloc[0])
            total = np.concatenate([[0], np.cumsum(sizes)])
            first = max(0, int(np.searchsorted(total, room - used, "right")) - 1) if used else 0
            follow = next_starts(sizes, room)
            begins = np.zeros(len(sizes), np.int64)
            i = first
            while i < len(sizes):
                begins[i] = 1
                i = int(follow[i])
            if not used and len(sizes):
                begins[first] = 0  # nothing was open: its first row begins the window that is counted already
            yield pd.DataFrame({"table_id": key[0], "block_id": key[1], "row": own["row"], "window_id": own["window"] + np.cumsum(begins)})

    both = dealt.join(entries, CHUNK).repartition(*CHUNK).sortWithinPartitions(*CHUNK, "ord")
    return both.select(*CHUNK, "row", "ord", "size", "fixed", "used", "window").mapInPandas(numbered, "table_id string, block_id int, row int, window_id int")


PARTS = ["table_id", "block_id", "of"]


def _arrow_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """As _runs, of Arrow batches."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        told = pd.DataFrame({k: batch.column(k).to_pandas() for k in keys})
        new = (told != told.shift()).any(axis=1).to_numpy()
        new[0] = True
        cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = tuple(told.iloc[a])
            if own != key and held:
                yield key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = own
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def _before(own: pa.Table) -> int:
    """How many of the run's rows lie before its chunk."""
    return int((own.column("chunk").to_numpy() != own.column("of").to_numpy()).sum())


def _tuples(own: pa.Table) -> list[tuple]:
    return list(own.to_pandas().itertuples(index=False))


def _begun(fold: Callable[[tuple], object], row, quiet: bool = True):
    state = fold(row)
    state.quiet = quiet
    state.add(row)
    return state


def _told(back: list[tuple], mine: list[tuple], fold: Callable[[tuple], object]) -> list[tuple[int, int, int]]:
    """(row that may have begun the window open before mine, row that begins the one open after, windows closed)."""
    ends: dict[int, tuple[int, int]] = {}

    def follow(i: int) -> tuple[int, int]:
        """(row that begins the last window, windows closed) of a window that begins at row i."""
        path = []
        while i not in ends:
            state, j, out = _begun(fold, mine[i]), i + 1, []
            while j < len(mine) and not out:
                out = state.add(mine[j])
                j += 1
            if not out:
                ends[i] = (i, 0)
                break
            path.append((i, len(out)))
            i = j - 1
        last, closed = ends[i]
        for i, n in reversed(path):
            closed += n
            ends[i] = (last, closed)
        return last, closed

    told = []
    if not back:
        state = fold(mine[0])
        state.quiet = True
        n = len(state.add(mine[0]))
        last, closed = follow(0)
        told.append((-1, int(mine[last].ord), n + closed))
    for s in range(len(back) - 1, -1, -1):
        state = _begun(fold, back[s])
        if any(state.add(r) for r in back[s + 1 :]):
            break  # a window from here, and so any from before, is closed before the chunk
        for j, r in enumerate(mine):
            out = state.add(r)
            if out:
                last, closed = follow(j)
                told.append((int(back[s].ord), int(mine[last].ord), len(out) + closed))
                break
        else:
            told.append((int(back[s].ord), int(back[s].ord), 0))
    return told


def _spread(rows: DataFrame, chunk_rows: int, reach: int) -> tuple[DataFrame, DataFrame, bool]:
    """(rows, rows as often as a chunk (of) needs them, whether no row is missing); rows are written."""
    from gridscribe.plans.staging import written

    rows = written(rows.withColumn("chunk", F.floor(F.col("ord") / chunk_rows).cast("int")), "rows")
    gaps = rows.groupBy("table_id", "block_id").agg((F.max("ord") - F.min("ord") + 1 - F.count("*")).alias("gap")).filter("gap <> 0")
    late = F.col("ord") % chunk_rows >= chunk_rows - reach
    of = F.explode(F.when(late | F.lit(reach >= chunk_rows), F.sequence(F.col("chunk"), F.floor((F.col("ord") + reach) / chunk_rows).cast("int"))).otherwise(F.array("chunk")))
    return rows, rows.withColumn("of", of), gaps.isEmpty()


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*PARTS).sortWithinPartitions(*PARTS, "ord")


def _entries(spread: DataFrame, fold: Callable[[tuple], object]) -> DataFrame:
    """Per chunk (of) the row that begins the window open at its start, that window's number, and whether it is a table's last.

    upto: of the last chunk, the number of the table's windows.
    """
    from gridscribe.plans.staging import written

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in _arrow_runs(batches, PARTS):
            n = _before(own)
            if n == own.num_rows:
                continue
            quick = fold(_tuples(own.slice(n, 1))[0]).quick(own)
            if quick:
                told = quick.told(n)
            else:
                every = _tuples(own)
                told = _told(every[:n], every[n:], fold)
            begins, last, closed = (pa.array([list(x)], pa.list_(pa.int32())) for x in zip(*told, strict=True))
            block, of = (pa.array([int(x)], pa.int32()) for x in key[1:])
            yield pa.RecordBatch.from_pydict({"table_id": pa.array([key[0]]), "block_id": block, "of": of, "ord": of, "begins": begins, "last": last, "closed": closed})

    class Followed:
        def __init__(self, row):
            self.begin, self.window, self.held = -1, 0, None

        def add(self, row) -> list[tuple]:
            out = [(*self.held, False, 0)] if self.held else []
            self.held = (row.table_id, row.block_id, row.of, self.begin, self.window)
            i = list(row.begins).index(self.begin)
            self.begin, self.window = int(row.last[i]), self.window + int(row.closed[i])
            return out

        def end(self) -> list[tuple]:
            return [(*self.held, True, self.window + 1)]

    tables = _dealt(spread).mapInArrow(through, "table_id string, block_id int, of int, ord int, begins array<int>, last array<int>, closed array<int>")
    return written(folded(tables, Followed, "table_id string, block_id int, of int, begin int, window int, final boolean, upto int"), "entries")


def chunked(rows: DataFrame, fold: Callable[[tuple], object], schema: str = PASSAGES, chunk_rows: int = 8192, reach: int = WINDOW // 2 + 1) -> DataFrame:
    """As folded, but a table is as many tasks as it has chunks of rows.

    For folds whose open window is told by the row that began it: then adding rows to a fresh window that begins there gives the
    same. No window holds more than `reach` rows, so each chunk also gets that many rows before it. It tells, for every row
    before it that may have begun the window that is open at its start, which window is open at its end and how many
    are closed; these short tables are followed in order, and then all chunks write their windows at the same time.
    """
    rows, spread, whole = _spread(rows, chunk_rows, reach)
    if not whole:  # rows without any cell are missing: what a chunk gets before it could be too little
        return folded(rows.drop("chunk"), fold, schema)
    entries = _entries(spread, fold)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _arrow_runs(batches, PARTS):
            n = _before(own)
            begin, window, final = (own.column(c)[n].as_py() for c in ("begin", "window", "final"))
            state = fold(_tuples(own.slice(n, 1))[0])
            quick = state.quick(own)
            if quick:
                yield quick.rendered(begin, final, window, kinds)
                continue
            every = _tuples(own)
            out: list[tuple] = []
            if begin >= 0:
                before = [r for r in every[:n] if r.ord >= begin]
                state = _begun(fold, before[0], quiet=False)
                for r in before[1:]:
                    state.add(r)
            state.window = window
            for r in every[n:]:
                out += state.add(r)
            if final:
                out += state.end()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k.type) for i, k in enumerate(kinds)], schema=kinds)

    return _dealt(spread.join(entries, PARTS)).mapInArrow(packed, schema)


def chunked_counts(rows: DataFrame, fold: Callable[[tuple], object], chunk_rows: int = 8192, reach: int = WINDOW // 2 + 1) -> DataFrame:
    """(table_id, block_id, n): how many windows `chunked` gives for a fold of coded rows; texts are neither moved nor rendered."""
    bare = rows.withColumn("cells", F.transform("cells", lambda c: F.struct(c["col"].alias("col"), F.lit("").alias("text"), c["size"].alias("size"), c["key"].alias("key"))))
    rows, spread, whole = _spread(bare, chunk_rows, reach)
    if not whole:
        return folded(rows.drop("chunk"), fold).groupBy("table_id", "block_id").agg(F.count("*").alias("n"))
    return _entries(spread, fold).filter("final").select("table_id", "block_id", F.col("upto").cast("long").alias("n"))


class Quick:
    """A run of coded rows as arrays, with the end of the window that would begin at each row.

    A window's size is what its rows add by themselves and the costs of the keys that may be coded in it: those of two tokens or more
    that the run holds twice. It grows with every row, so the ends follow from one pass with two ends of a sliding window.
    """

    def __init__(self, state: Coded, own: pa.Table):
        self.state, self.ords, self.rows = state, own.column("ord").to_numpy(), own.column("row").to_numpy()
        cells = own.column("cells").combine_chunks()
        cells = cells.chunk(0) if isinstance(cells, pa.ChunkedArray) else cells
        flat, lens = cells.flatten(), pc.list_value_length(cells).to_numpy().astype(np.int64)
        n = len(lens)
        self.at = np.concatenate([[0], np.cumsum(lens)])
        self.texts, self.cols = flat.field("text"), flat.field("col").to_numpy()
        keys, size = flat.field("key").dictionary_encode().indices.to_numpy().astype(np.int64), flat.field("size").to_numpy().astype(np.int64)
        n_keys = int(keys.max()) + 1
        width = np.zeros(n_keys, np.int64)
        width[keys] = size
        self.even = bool((width[keys] == size).all())
        may = (size > 1) & (np.bincount(keys, minlength=n_keys)[keys] > 1) if state.code_cells else np.zeros(len(keys), bool)
        self.pos = np.flatnonzero(may)
        self.pos_at, self.pos_key = np.searchsorted(self.pos, self.at), keys[self.pos]
        owner = np.repeat(np.arange(n), lens)
        alone = size if state.by_plain_size else np.where(may, 0, size)
        units, unit_row = (self.pos_key, owner[self.pos]) if not state.by_plain_size else (self.pos_key[:0], owner[:0])
        if state.code_headers:
            heads = np.zeros(max(state.names) + 1, np.int64)
            heads[list(state.names)] = [x for _, x in state.names.values()]
            width = np.concatenate([width, heads])
            paid = heads[self.cols] > 1
            alone = alone + 1 + np.where(paid, 0, heads[self.cols])
            units, unit_row = np.concatenate([units, n_keys + self.cols[paid]]), np.concatenate([unit_row, owner[paid]])
        self.base = state.title_size + 1 + lens + np.bincount(owner, alone, n).astype(np.int64)
        units = units[np.argsort(unit_row, kind="stable")]
        unit_at = np.concatenate([[0], np.cumsum(np.bincount(unit_row, minlength=n))])
        self.units, self.unit_at, self.width = units.tolist(), unit_at.tolist(), width.tolist()
        x = np.maximum(width, 2)
        turn = (x + 3) // (x - 1)  # so many occurrences are not dearer plain than coded
        self.turn, self.jump = turn.tolist(), (x + turn + 4 - x * turn).tolist()
        self.ends = self._ends() if self.even else None

    def _ends(self) -> list[int] | None:
        """The first row that the window beginning at each row does not hold; None where a row is too wide for any window."""
        limit, used, a, n = self.state.limit, self.state.header_size, 0, len(self.base)
        base, units, at, width, turn, jump = self.base.tolist(), self.units, self.unit_at, self.width, self.turn, self.jump
        count, out = [0] * len(width), [n] * n
        for b in range(n):
            d = base[b]
            for k in units[at[b] : at[b + 1]]:
                y, t = count[k], turn[k]
                count[k] = y + 1
                d += width[k] if y < t else 1 if y > t else jump[k]
            used += d
            while used > limit:
                if a == b:
                    return None
                out[a] = b
                d = base[a]
                for k in units[at[a] : at[a + 1]]:
                    y, t = count[k] - 1, turn[k]
                    count[k] = y
                    d += width[k] if y < t else 1 if y > t else jump[k]
                used -= d
                a += 1
        return out

    def told(self, before: int) -> list[tuple[int, int, int]]:
        """As _told; the first rows lie before the chunk."""
        n = len(self.ends)
        last, closed = list(range(n)), [0] * n
        for i in range(n - 1, -1, -1):
            j = self.ends[i]
            if j < n:
                last[i], closed[i] = last[j], closed[j] + 1
        if not before:
            return [(-1, int(self.ords[last[0]]), closed[0])]
        begins = [i for i in range(before) if self.ends[i] >= before]
        return [(int(self.ords[i]), int(self.ords[last[i]]), closed[i]) for i in begins]

    def rendered(self, begin: int, final: bool, window: int, kinds: pa.Schema) -> pa.RecordBatch:
        """The passages of the windows that end here, from the one that begins at the row with ord `begin` (-1: the first)."""
        state, n = self.state, len(self.ends)
        starts = [int(np.searchsorted(self.ords, begin)) if begin >= 0 else 0]
        while self.ends[starts[-1]] < n:
            starts.append(self.ends[starts[-1]])
        if final:
            starts.append(n)
        at, pos, pos_at, keys = self.at.tolist(), self.pos.tolist(), self.pos_at.tolist(), self.pos_key.tolist()
        texts, total = self.texts.to_pylist(), np.concatenate([[0], np.cumsum(self.base)]).tolist()
        cols = self.cols.tolist() if state.code_headers else []
        title, joint = f"{state.title} [SEP] ", state.joint
        out: list[tuple] = []
        for a, e in zip(starts, starts[1:], strict=False):
            low, parts = at[a], texts[at[a] : at[e]]
            own = range(pos_at[a], pos_at[e])
            seen: dict[int, int] = {}
            codes: dict[int, str] = {}
            refers = []
            for i in own:
                k = keys[i]
                seen[k] = y = seen.get(k, 0) + 1
                if y > self.turn[k] and k not in codes:
                    codes[k] = code = f"[E{len(codes) + 1}]"
                    refers.append(f"{code} is {texts[pos[i]]} [SEP] ")
            if codes:
                for i in own:
                    if keys[i] in codes:
                        parts[pos[i] - low] = codes[keys[i]]
            size = state.header_size + total[e] - total[a]
            if not state.by_plain_size:
                size += sum(Coded.cost(self.width[k], y) for k, y in seen.items())
            heads: dict[int, str] = {}
            if state.code_headers:
                for h, y in enumerate(np.bincount(self.cols[low : at[e]]).tolist()):
                    x = state.names[h][1] if y else 0
                    size += Coded.cost(x, y) if x > 1 else 0
                    if x * y > x + y + 3:
                        heads[h] = f"[C{h}]"
                parts = [f"{heads.get(h, state.names[h][0])} : {part}" for h, part in zip(cols[low : at[e]], parts, strict=True)]
            lines = lambda parts: "".join(f"{title}{joint.join(parts[at[i] - low : at[i + 1] - low])}  [SEP] " for i in range(a, e))  # noqa: B023, E731
            named = "".join(f"{code} is {state.names[h][0]} [SEP] " for h, code in heads.items())
            plain = (state.header + lines(texts[low : at[e]]),) if isinstance(state, Paired) else ()
            out.append((state.header + named + "".join(refers) + lines(parts), int(size), [*heads.values(), *codes.values()], *plain))
        first, end, m = starts[0], starts[-1], len(out)
        rows = pa.ListArray.from_arrays(pa.array(np.array(starts) - first, pa.int32()), pa.array(self.rows[first:end], pa.int32()))
        shown = pa.ListArray.from_arrays(pa.array(self.at[first : end + 1] - self.at[first], pa.int32()), pa.array(self.cols[self.at[first] : self.at[end]], pa.int32()))
        shown = pa.ListArray.from_arrays(pa.array(np.array(starts) - first, pa.int32()), shown)
        told = [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int32(), pa.list_(pa.string())))]
        made = [pa.array([state.key[0]] * m, pa.string()), pa.array([int(state.key[1])] * m, pa.int32()), pa.array(range(window, window + m), pa.int32()), *told[:2], rows, shown, told[2]]
        if isinstance(state, Paired):
            made.append(pa.array([r[3] for r in out], pa.string()))
        return pa.RecordBatch.from_arrays(made, schema=pa.schema([pa.field(k.name, v.type) for k, v in zip(kinds, made, strict=True)]))


class Coded:
    """Dictionary-coded windows. Codes: repeated cells ([E#]) and, with code_headers, column names ([C#]).

    The cost of a window is exact at any time: a key of x tokens that occurs y times costs min(y * x, y + x + 3).
    """

    quiet = False  # whether windows are only counted

    def __init__(self, row, limit: int, code_cells: bool = True, code_headers: bool = False, show_header: bool = True, by_plain_size: bool = False, joint: str = " ; "):
        self.key, self.limit, self.code_cells, self.code_headers = (row.table_id, row.block_id), limit, code_cells, code_headers
        self.title, self.title_size = row.title, row.title_size
        self.header, self.header_size = (row.header, row.header_size) if show_header else ("", 0)
        self.names = dict(zip(row.cols, zip(row.names, row.name_sizes, strict=True), strict=True))
        self.by_plain_size, self.joint, self.window = by_plain_size, joint, 0
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple[int, list[dict]]] = []
        self.count: dict[str, int] = {}
        self.width: dict[str, int] = {}
        self.heads: dict[int, int] = {}
        self.size = self.header_size

    @staticmethod
    def cost(x: int, y: int) -> int:
        return min(x * y, x + y + 3) if y else 0

    def quick(self, own: pa.Table) -> Quick | None:
        """The run as arrays; None where a row is too wide for any window, or a key has several sizes."""
        if type(self) not in (Coded, Paired) or "cols" in [f.name for f in own.schema.field("cells").type.value_type]:
            return None
        out = Quick(self, own)
        return out if out.ends else None

    def delta(self, cells: list[dict]) -> int:
        out, more, more_heads = self.title_size + 1, {}, {}
        for c in cells:
            if self.code_cells and not self.by_plain_size:
                k, x = c["key"], int(c["size"])
                y = self.count.get(k, 0) + more.get(k, 0)
                out += self.cost(self.width.get(k, x), y + 1) - self.cost(self.width.get(k, x), y) + 1
                more[k] = more.get(k, 0) + 1
            else:
                out += int(c["size"]) + 1
            if self.code_headers:
                h, x = int(c["col"]), int(self.names[int(c["col"])][1])
                y = self.heads.get(h, 0) + more_heads.get(h, 0)
                out += self.cost(x, y + 1) - self.cost(x, y) + 1
                more_heads[h] = more_heads.get(h, 0) + 1
        return out

    def add(self, row) -> list[tuple]:
        return self.put(int(row.row), list(row.cells))

    def put(self, row: int, cells: list[dict]) -> list[tuple]:
        out: list[tuple] = []
        if self.rows and self.size + self.delta(cells) > self.limit:
            out = self.end()
        if not self.rows and self.size + self.delta(cells) > self.limit and len(cells) > 1:
            half = len(cells) // 2  # too wide for any window: its columns are halved
            return out + self.put(row, cells[:half]) + self.put(row, cells[half:])
        self.size += self.delta(cells)
        for c in cells:
            self.count[c["key"]] = self.count.get(c["key"], 0) + 1
            self.width.setdefault(c["key"], int(c["size"]))
            self.heads[int(c["col"])] = self.heads.get(int(c["col"]), 0) + 1
        self.rows.append((row, cells))
        return out

    def coded(self) -> tuple[dict, dict]:
        """key -> (code, text), column -> code, in the order in which their occurrences first paid for a code."""
        seen: dict[str, int] = {}
        codes: dict[str, tuple[str, str]] = {}
        heads = {h: f"[C{h}]" for h, y in self.heads.items() if self.code_headers and self.names[h][1] * y > self.names[h][1] + y + 3}
        for _, cells in self.rows if self.code_cells else ():
            for c in cells:
                k, x = c["key"], self.width[c["key"]]
                seen[k] = y = seen.get(k, 0) + 1
                if k not in codes and x * y > x + y + 3:
                    codes[k] = (f"[E{len(codes) + 1}]", c["text"])
        return codes, heads

    def text(self, codes: dict, heads: dict) -> str:
        refers = [f"{code} is {self.names[h][0]} [SEP] " for h, code in sorted(heads.items())] + [f"{code} is {text} [SEP] " for code, text in codes.values()]
        lines = []
        for _, cells in self.rows:
            parts = []
            for i, c in enumerate(cells):
                head = f"{heads.get(int(c['col']), self.names[int(c['col'])][0])} : " if self.code_headers else ""
                value = codes[c["key"]][0] if c["key"] in codes else c["text"]
                parts.append(f"{head}{value}{self.joint if i < len(cells) - 1 else '  [SEP] '}")
            lines.append(f"{self.title} [SEP] {''.join(parts)}")
        return self.header + "".join(refers) + "".join(lines)

    def end(self) -> list[tuple]:
        if not self.rows:
            return []
        if self.quiet:
            self.window += 1
            self.clear()
            return [()]
        codes, heads = self.coded()
        used = [heads[h] for h in sorted(heads)] + [code for code, _ in codes.values()]
        out = (*self.key, self.window, self.text(codes, heads), self.size, [r for r, _ in self.rows], [[int(x) for c in cells for x in (c["cols"] if "cols" in c else [c["col"]])] for _, cells in self.rows], used)
        self.window += 1
        self.clear()
        return [self.finish(out)]

    def finish(self, out: tuple) -> tuple:
        return out


class Paired(Coded):
    """Windows of the plain size, rendered twice: compressed, and as they are."""

    def __init__(self, row, limit: int):
        super().__init__(row, limit, by_plain_size=True)

    def end(self) -> list[tuple]:
        rows = self.rows
        out = super().end()
        if not out or self.quiet:
            return out
        self.rows = rows
        plain = self.text({}, {})
        self.clear()
        return [(*out[0], plain)]


class CellWindows:
    """Cells of a table one after another; flush_rows: a window never spans rows.

    The title stands before the first cell of a row and before the first cell of an empty window; a cell that did not fit
    starts the next window as it was rendered.
    """

    quiet = False

    def __init__(self, row, limit: int, flush_rows: bool):
        self.key, self.limit, self.flush_rows = (row.table_id, row.block_id), limit, flush_rows
        self.title, self.title_size, self.window = f"{row.title} [SEP]", row.title_size + 1, 0
        self.names = dict(zip(row.cols, zip(row.names, row.name_sizes, strict=True), strict=True))
        self.held: list[tuple[str, int, int]] = []
        self.size = 0

    def quick(self, own: pa.Table) -> None:
        return None

    def add(self, row) -> list[tuple]:
        out: list[tuple] = []
        last = len(row.cells) - 1
        for i, c in enumerate(row.cells):
            name, name_size = self.names[int(c["col"])]
            titled = i == 0 or not self.held
            text = f"{self.title if titled else ''}{name} : {c['text']} {';' if i < last else '[SEP]'} "
            size = int(self.title_size * titled + name_size + 1 + c["size"] + 1)
            if self.held and self.size + size > self.limit:
                out += self.end()
            self.held.append((text, int(row.row), int(c["col"])))
            self.size += size
        if self.flush_rows:
            out += self.end()
        return out

    def end(self) -> list[tuple]:
        if not self.held:
            return []
        out = (*self.key, self.window, "".join(t for t, _, _ in self.held), self.size, [r for _, r, _ in self.held], [[c] for _, _, c in self.held], [])
        self.window, self.held, self.size = self.window + 1, [], 0
        return [out]


def with_passage_ids(passages: DataFrame) -> DataFrame:
    from gridscribe.plans.staging import numbered

    return numbered(passages, ["table_id", "block_id", "window_id"], "p_id")


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item: the first with room; an item above the capacity gets a bin of its own."""
    rooms: list[int] = []
    out = []
    for s in sizes:
        at = next((i for i, r in enumerate(rooms) if s <= r), None)
        if at is None:
            rooms.append(max(capacity, s))
            at = len(rooms) - 1
        rooms[at] -= s
        out.append(at)
    return out


def first_fit_bins(items: DataFrame, capacity: int) -> DataFrame:
    """Bins of items (table_id, ord, size): first-fit per table. Items of a table are its columns, so a group is small."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord")
        return frame.assign(bin=first_fit(frame["size"].tolist(), capacity))

    return items.select("table_id", F.col("ord").cast("int").alias("ord"), F.col("size").cast("int").alias("size")).groupBy("table_id").applyInPandas(run, "table_id string, ord int, size int, bin int")


def disjoint_sets(sets: list[tuple[frozenset, float]]) -> list[int]:
    """Greedy weighted set packing: by weight over the root of the size, pairwise disjoint."""
    taken: set = set()
    out = []
    for i in sorted(range(len(sets)), key=lambda i: (-sets[i][1] / len(sets[i][0]) ** 0.5, i)):
        if not taken & sets[i][0]:
            taken |= sets[i][0]
            out.append(i)
    return out
