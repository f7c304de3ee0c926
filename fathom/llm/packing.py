"""Best-fit packing of token pieces into sequences: local best fit, then a tree of merges of underfull bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, ship, whole_text

_MEMBERS = "array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"
_AT_ONCE = 1 << 20  # bytes of text encoded together
_BINS = f"bin_id long, used int, grp long, open boolean, members {_MEMBERS}"


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each item, in the given order: the open bin with the least room that suffices, else a new one.

    A bit mask over the capacity holds which amounts of room exist, so an item costs one shift and one lowest set bit."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, out = 0, 0, []
    for s in sizes:
        if fits := mask >> s:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            b, r, bins = bins, capacity, bins + 1
        out.append(b)
        if r > s:
            room[r - s].append(b)
            mask |= 1 << (r - s)
    return out


def _members(doc, piece, start, length, crc, offset):
    import pyarrow as pa

    return pa.StructArray.from_arrays([doc, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, offset))], names=["doc_id", "piece", "start", "length", "ids_crc32", "offset"])


def _frame(used, ends, members, round_no: int, grp: int, first: int, slack_at: int, keep_open: int):
    """Bins as a table: bin k has the members before ends[k] that no bin before it has. Of those with less than slack_at ids the keep_open emptiest are open."""
    import numpy as np
    import pyarrow as pa

    by = np.argsort(used, kind="stable")
    by = by[used[by] < slack_at][:keep_open]
    is_open = np.zeros(len(used), bool)
    is_open[by] = True
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), members)
    return pa.table({"bin_id": pa.array(np.arange(len(used)) + (round_no << 56 | grp << 28 | first), pa.int64()), "used": pa.array(used, pa.int32()), "grp": pa.array(np.full(len(used), grp), pa.int64()), "open": pa.array(is_open), "members": lists})


def _by_bin(sizes, capacity: int):
    """Best fit of sizes, in their order: (item numbers by bin, each item's place in its bin, bins' fill, each bin's end among the items)."""
    import numpy as np

    bins = np.array(best_fit(sizes.tolist(), capacity), np.int64)
    by = np.argsort(bins, kind="stable")
    ends = np.cumsum(np.bincount(bins)) if len(bins) else np.empty(0, np.int64)
    before = np.cumsum(sizes[by]) - sizes[by]
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    base = before[begins] if len(ends) else before
    used = np.add.reduceat(sizes[by], begins) if len(ends) else sizes
    return by, before - np.repeat(base, np.diff(ends, prepend=0)), used, ends


def cut_all(sizes, capacity: int):
    """(row, piece, start, length) of the pieces of texts of so many ids: full ones, but for the first, which takes the remainder."""
    import numpy as np

    pieces = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    head = (sizes - 1) % capacity + 1
    return row, piece, np.where(piece > 0, head[row] + (piece - 1) * capacity, 0), np.where(piece > 0, capacity, head[row])


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    import numpy as np

    _, _, start, length = cut_all(np.array([n]), capacity)
    yield from zip(start.tolist(), length.tolist(), strict=True)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, slack: int = 4, keep_open: int = 1024, fan_in: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document's ids into sequences of at most capacity ids; one row per piece.

    Method: each input partition packs its own pieces by best fit, longest first, without a shuffle, and emits bins that are
    within slack of full. The underfull bins, as items, go up a tree: fan_in groups merge into one by best fit until one is
    left. A group hands its keep_open emptiest bins on and emits its others as they are, so a task at any level gets at most
    fan_in * keep_open bins. That costs no merge as long as keep_open >= fan_in (checked): after best fit at most one
    bin of a group is at most half full, and of two bins that go together one is, so a merge joins at most fan_in of them to
    others, and where one of those has room enough, so has one of the fan_in emptiest. No row is dropped.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null text counts as empty and makes a piece with
    the end id alone. Null ids stay null. Repeated rows are packed each. An empty table gives no rows. Other columns of docs
    are not read, whatever their names. Equal input partitions give equal bins, so a task that runs again changes nothing.
    """
    if keep_open < fan_in or fan_in < 2:
        raise ValueError("keep_open must be at least fan_in, and fan_in at least 2")
    slack_at = capacity - slack

    def local(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import encoder, slices

        enc, grp = encoder(tokenizer, end_id), TaskContext.get().partitionId()
        kept, n_whole = [], 0
        for batch in batches:
            for at, texts in slices(batch.column(1), _AT_ONCE):
                give_back()  # what the slice before, or another query's task, has freed
                ids, ends = enc.encode_batch(texts)
                sizes = np.diff(ends, prepend=0)
                row, piece, start, length = cut_all(sizes, capacity)
                begin = (ends - sizes)[row] + start
                view = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = np.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)], np.int64)
                doc = batch.column(0).slice(at, len(texts)).take(pa.array(row))
                whole = length == capacity
                if n := int(whole.sum()):
                    members = _members(doc.filter(pa.array(whole)), piece[whole], start[whole], length[whole], crc[whole], np.zeros(n, np.int64))
                    yield from _frame(length[whole], np.arange(1, n + 1), members, 1, grp, n_whole, slack_at, 0).to_batches()
                    n_whole += n
                kept.append((doc.filter(pa.array(~whole)), *(x[~whole] for x in (piece, start, length, crc))))
        if not kept:
            return
        doc = pa.concat_arrays([x[0] for x in kept])
        piece, start, length, crc = (np.concatenate([x[i] for x in kept]) for i in range(1, 5))
        order = np.lexsort((crc, start, piece, doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False), -length))
        by, offset, used, ends = _by_bin(length[order], capacity)
        by = order[by]
        for t in _frame(used, ends, _members(doc.take(pa.array(by)), piece[by], start[by], length[by], crc[by], offset), 2, grp, 0, slack_at, keep_open).to_batches(max_chunksize=5000):
            yield t

    def merge(round_no: int):
        def run(key, t):
            import numpy as np
            import pyarrow as pa

            t = t.sort_by([("used", "descending"), ("bin_id", "ascending")]).combine_chunks()
            size = t.column("used").to_numpy().astype(np.int64)
            lists = t.column("members").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            first, count = lists.offsets.to_numpy()[:-1].astype(np.int64), np.diff(lists.offsets.to_numpy()).astype(np.int64)
            by, offset, used, ends = _by_bin(size, capacity)
            upto = np.cumsum(count[by])
            at = np.repeat(first[by] - upto + count[by], count[by]) + np.arange(int(upto[-1]) if len(upto) else 0)
            flat = lists.values.take(pa.array(at))
            old = [flat.field(i) for i in range(6)]
            members = _members(old[0], *old[1:5], old[5].to_numpy() + np.repeat(offset, count[by]))
            return _frame(used, upto[ends - 1] if len(ends) else ends, members, round_no, key[0].as_py(), 0, slack_at, keep_open)

        return run

    ship(docs.sparkSession)
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    bins = materialize(pieces.mapInArrow(local, _BINS), "bins")
    done = [bins.where("not open")]
    round_no = 3
    groups = (bins.where("open").agg(F.max("grp")).first()[0] or 0) + 1
    todo = bins.where("open")
    while groups > 1:
        groups = -(-groups // fan_in)
        merged = todo.withColumn("grp", F.floor(F.col("grp") / fan_in)).groupBy("grp").applyInArrow(merge(round_no), _BINS)
        bins = materialize(merged, "bins")
        done.append(bins.where("not open"))
        todo = bins.where("open")
        round_no += 1
    out = todo
    for d in done:
        out = out.union(d)
    return out.select("bin_id", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", F.col("bin_id").alias("sequence_id"), "m.offset")
