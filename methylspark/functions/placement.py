"""Arrow kernels for the running sums inside one read.

Spark has no linear prefix sum over an array column (``aggregate`` with
``concat`` copies the array at each step), and long reads hold thousands of
CIGAR operations and modified bases. These helpers take the text of both apart
and turn lengths into positions, for a whole Arrow batch at a time, without a
Python loop over reads.
"""

from __future__ import annotations

WINDOW_FIELDS = ("region_id INT, read_key BIGINT, chrom STRING, pos ARRAY<INT>, "
                 "ml ARRAY<SMALLINT>")
OWN_WINDOW_FIELDS = "region_id INT, read_id INT, read_key BIGINT, chrom STRING, pos ARRAY<INT>, " \
                    "ml ARRAY<SMALLINT>"
CALL_FIELDS = "read_key BIGINT, chrom STRING, seq_idx INT, pos INT, ml SMALLINT"
BIN_FIELDS = "read_key BIGINT, chrom STRING, bin INT, calls BINARY"
CHECKED_FIELDS = "read_key BIGINT, chrom STRING, pos INT, ml SMALLINT"
PACKED_FIELDS = OWN_WINDOW_FIELDS
LIST_FIELDS = "region_id INT, read_id INT, ml ARRAY<SMALLINT>, cpg_id ARRAY<INT>"
WORD_FIELDS = "region_id INT, read_id INT, words ARRAY<INT>, masks ARRAY<BIGINT>, bits ARRAY<BIGINT>"
NUMBERED_FIELDS = "region_id INT, read_id INT, chrom STRING, pos INT, ml SMALLINT, cpg_id INT"
BLOCK_FIELDS = "read_key BIGINT, seq_start INT, ref_start INT, length INT"
SITE_FIELDS = "chrom STRING, pos INT"
SITE_BIN_FIELDS = "chrom STRING, bin INT, sites ARRAY<INT>"


def _make_tools():
    import numpy as np
    import pyarrow as pa

    def text(column):
        """Bytes and row offsets of a string column."""
        column = column.cast(pa.large_string())
        _, offsets, data = column.buffers()
        first, rows = column.offset, len(column)
        bounds = np.frombuffer(offsets, dtype=np.int64)[first:first + rows + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
        return raw, bounds

    def lists(column):
        """Values and row offsets of a list column."""
        bounds = column.offsets.to_numpy().astype(np.int64)
        values = column.values.to_numpy(zero_copy_only=False)[bounds[0]:bounds[-1]]
        return values, bounds - bounds[0]

    def owners(bounds):
        return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def running(values, bounds):
        """Running sum that restarts at each row."""
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return total[1:] - np.repeat(total[bounds[:-1]], np.diff(bounds))

    def numbers(raw, at, bounds):
        """Runs of digits at the sorted places ``at`` of ``raw``: last place and value of each. A run
        ends with its row."""
        begins = np.zeros(len(raw) + 1, bool)
        begins[bounds] = True
        head = np.flatnonzero(np.append(True, (np.diff(at) != 1) | begins[at[1:]])[:len(at)])
        if not len(head):
            return head, head
        last = np.append(head[1:], len(at)) - 1
        power = np.repeat(last, last - head + 1) - np.arange(len(at))
        digit = raw[at].astype(np.int64) - ord("0")
        if len(head) < len(at):
            digit = digit * np.power(10, power)
        return at[last], np.add.reduceat(digit, head)

    def operations(batch):
        """Lengths and letters of all CIGAR operations, and row offsets."""
        raw, bounds = text(batch.column("cigar"))
        raw, bounds = raw[bounds[0]:bounds[-1]], bounds - bounds[0]
        last, lengths = numbers(raw, np.flatnonzero((raw >= ord("0")) & (raw <= ord("9"))), bounds)
        end = bounds[np.searchsorted(bounds, last, "right")]
        code = raw[np.minimum(last + 1, len(raw) - 1)]
        real = (last + 1 < end) & np.isin(code, np.frombuffer(b"MIDNSHP=X", np.uint8))
        return lengths[real], code[real], np.searchsorted(last[real], bounds)

    def blocks(batch):
        """Aligned blocks of all reads: (row, seq_start, ref_start, length)."""
        lengths, codes, bounds = operations(batch)
        row = owners(bounds)
        in_query = np.isin(codes, np.frombuffer(b"MIS=X", np.uint8))
        in_ref = np.isin(codes, np.frombuffer(b"MDN=X", np.uint8))
        start = batch.column("align_start").to_numpy(zero_copy_only=False).astype(np.int64)
        used_query, used_ref = lengths * in_query, lengths * in_ref
        seq_start = running(used_query, bounds) - used_query
        ref_start = running(used_ref, bounds) - used_ref + start[row]
        keep = in_query & in_ref & (lengths > 0)
        return row[keep], seq_start[keep], ref_start[keep], lengths[keep]

    def tags(batch):
        """Deltas of the modification ``code`` and their probabilities in all reads, and row offsets.

        Reads lacking the code, its deltas or enough probabilities have none. The probabilities of
        earlier codes precede ours, one per earlier delta; where ``compat`` says so the earlier
        section ends are subtracted from that count.
        """
        rows = batch.num_rows
        wanted = np.frombuffer(batch.column("code")[0].as_py().encode(), np.uint8)
        raw, bounds = text(batch.column("mm"))
        values, value_bounds = lists(batch.column("ml"))
        hit = np.ones(max(len(raw) - len(wanted) + 1, 0), bool)
        for k, byte in enumerate(wanted):
            hit &= raw[k:len(hit) + k] == byte
        at = np.flatnonzero(hit)
        first = np.searchsorted(at, bounds[:-1])
        at = np.append(at, len(raw))[first]
        row = np.flatnonzero(at + len(wanted) < bounds[1:])  # a delta must follow
        at, rest = at[row], at[row] + len(wanted)
        row, at, rest = (x[raw[rest] == ord(",")] for x in (row, at, rest))
        commas = np.append(0, np.cumsum(raw == ord(",")))
        offset = commas[at] - commas[bounds[row]]
        if batch.column("compat")[0].as_py():
            ends = np.append(0, np.cumsum(raw == ord(";")))
            offset = offset - ends[at] + ends[bounds[row]]
        is_digit = (raw >= ord("0")) & (raw <= ord("9"))
        other = np.flatnonzero(~is_digit & (raw != ord(",")))
        stop = np.minimum(np.append(other, len(raw))[np.searchsorted(other, rest)], bounds[row + 1])
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[rest] = 1
        inside[stop] -= 1
        last, deltas = numbers(raw, np.flatnonzero(is_digit & (np.cumsum(inside, dtype=np.int8)[:-1] > 0)), bounds)
        begin = np.searchsorted(last, rest)
        n = np.searchsorted(last, stop) - begin
        known = np.diff(value_bounds)[row]
        good = (n > 0) & (offset >= 0) & (offset + n <= known)
        row, n, begin, offset = row[good], n[good], begin[good], offset[good]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return (deltas[np.repeat(begin, n) + inner],
                values[np.repeat(value_bounds[row] + offset, n) + inner],
                np.append(0, np.cumsum(np.bincount(row, n, minlength=rows).astype(np.int64))))

    return np, pa, text, lists, owners, running, blocks, tags


def _placed(batch, tools):
    """Modified bases that exist in their read: row, index in the read, position, whether that is on
    the reference, probability."""
    np, _, text, _, owners, running, blocks, tags = tools
    raw, seq_bounds = text(batch.column("seq"))
    backward = batch.column("backward").to_numpy(zero_copy_only=False)
    wanted = np.where(backward, ord("G"), ord("C")).astype(np.uint8)
    c_at = np.flatnonzero(raw[seq_bounds[0]:seq_bounds[-1]] == np.repeat(
        wanted, np.diff(seq_bounds))) + seq_bounds[0]
    c_first = np.searchsorted(c_at, seq_bounds[:-1])
    c_count = np.searchsorted(c_at, seq_bounds[1:]) - c_first
    deltas, ml, bounds = tags(batch)
    row = owners(bounds)
    ordinal = running(deltas + 1, bounds) - 1
    real = ordinal < c_count[row]
    row, ordinal, ml = row[real], ordinal[real], ml[real]
    ordinal = np.where(backward[row], c_count[row] - 1 - ordinal, ordinal)
    seq_idx = c_at[c_first[row] + ordinal] - seq_bounds[row]

    b_row, b_seq, b_ref, b_len = blocks(batch)
    stride = np.int64(1) << 32
    if len(b_row):
        at = np.searchsorted(b_row * stride + b_seq, row * stride + seq_idx, "right") - 1
        safe = np.maximum(at, 0)
        hit = (at >= 0) & (b_row[safe] == row) & (seq_idx < b_seq[safe] + b_len[safe])
        pos = b_ref[safe] + seq_idx - b_seq[safe] + 1 - backward[row]
    else:
        hit, pos = np.zeros(len(row), bool), np.zeros(len(row), np.int64)
    return row, seq_idx, pos, hit, ml


def place_modified_bases(batches):
    """One row per modified base that exists in its read.

    ``pos`` is the 1-based reference position, null inside insertions and clips.
    """
    tools = np, pa, *_ = _make_tools()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        row, seq_idx, pos, hit, ml = _placed(batch, tools)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([
            batch.column("read_key").take(take),
            batch.column("chrom").take(take),
            pa.array(seq_idx.astype(np.int32)),
            pa.array(pos.astype(np.int32), mask=~hit),
            pa.array(ml.astype(np.int16)),
        ], names=["read_key", "chrom", "seq_idx", "pos", "ml"])


#: Calls in windows that are put out in one go.
CANDIDATES = 1 << 20


def _by_window(batch, tools, candidates):
    """Calls of the batch strictly inside the windows of their reads: ``(read, which, pos, ml)``, one
    entry per read and window that has a call, the last two as lists.

    ``candidates(rows, first, last)`` pairs reads with windows, as ``(place in rows, start, end,
    which)``. Calls are sorted once by read and position, so a window is a run of them: work follows
    what is put out, however many chromosomes a batch has or windows a read.
    """
    np, pa, *_ = tools
    row, _, pos, hit, ml = _placed(batch, tools)
    row, pos, ml = row[hit], pos[hit], ml[hit]
    if not len(row):
        return
    stride = np.int64(1) << 32
    key = row * stride + pos
    order = np.argsort(key, kind="stable")
    key, pos, ml = key[order], pos[order], ml[order]
    rows = np.unique(row)
    begin = np.searchsorted(key, rows * stride, "left")
    end = np.searchsorted(key, (rows + 1) * stride, "left")
    at, start, stop, which = candidates(rows, pos[begin], pos[end - 1])
    read = rows[at]
    low = np.searchsorted(key, read * stride + start, "right")
    many = np.searchsorted(key, read * stride + stop, "left") - low
    held = np.flatnonzero(many > 0)
    read, which, low, many = read[held], which[held], low[held], many[held]
    upto = np.append(0, np.cumsum(many))
    lo = 0
    while lo < len(read):
        hi = max(int(np.searchsorted(upto, upto[lo] + CANDIDATES, "right")) - 1, lo + 1)
        offsets = upto[lo:hi + 1] - upto[lo]
        c = np.repeat(low[lo:hi] - offsets[:-1], many[lo:hi]) + np.arange(offsets[-1])
        offsets = pa.array(offsets, pa.int32())
        yield (pa.array(read[lo:hi]), which[lo:hi],
               pa.ListArray.from_arrays(offsets, pa.array(pos[c].astype(np.int32))),
               pa.ListArray.from_arrays(offsets, pa.array(ml[c].astype(np.int16))))
        lo = hi


def place_in_windows(windows):
    """One row per read and window with a call strictly between the window's ends.

    ``windows`` is a broadcast of ``(chroms, starts, ends, region_ids)``: a number for every
    chromosome, and the windows by chromosome and start, starts and ends shifted by that number.
    """
    def run(batches):
        tools = np, pa, *_ = _make_tools()
        chroms, starts, ends, ids = windows.value
        width = int((ends - starts).max(initial=0))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            base = np.array([chroms.get(c, -1) for c in batch.column("chrom").to_pylist()],
                            np.int64) << 32

            def candidates(rows, first, last, base=base):
                known = base[rows] >= 0
                low = np.searchsorted(starts, base[rows] + np.maximum(first - width, 0), "left")
                many = np.where(known, np.searchsorted(starts, base[rows] + last, "left") - low, 0)
                at = np.repeat(np.arange(len(rows)), many)
                w = np.repeat(low - np.append(0, np.cumsum(many))[:-1], many) + np.arange(len(at))
                return at, starts[w] - base[rows[at]], ends[w] - base[rows[at]], w

            for read, w, pos, ml in _by_window(batch, tools, candidates):
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[w].astype(np.int32)), batch.column("read_key").take(read),
                    batch.column("chrom").take(read), pos, ml,
                ], names=["region_id", "read_key", "chrom", "pos", "ml"])

    return run


def place_in_own_windows(batches):
    """The same where each read brings its windows (arrays ``win_start``, ``win_end``, ``region_id``
    and ``read_id``, its number there)."""
    tools = np, pa, _, lists, owners, *_ = _make_tools()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        start, bounds = lists(batch.column("win_start"))
        end, region, number = (lists(batch.column(c))[0] for c in ("win_end", "region_id", "read_id"))
        owner = owners(bounds)

        def candidates(rows, first, last, start=start, end=end, owner=owner):
            place = np.searchsorted(rows, owner)
            safe = np.minimum(place, len(rows) - 1)
            which = np.flatnonzero(rows[safe] == owner)
            return safe[which], start[which].astype(np.int64), end[which].astype(np.int64), which

        for read, w, pos, ml in _by_window(batch, tools, candidates):
            yield pa.RecordBatch.from_arrays([
                pa.array(region[w].astype(np.int32)), pa.array(number[w].astype(np.int32)),
                batch.column("read_key").take(read), batch.column("chrom").take(read), pos, ml,
            ], names=["region_id", "read_id", "read_key", "chrom", "pos", "ml"])


def place_in_bins(width):
    """One row per read and bin of ``width`` bases with the calls there that are on the reference.

    ``calls`` holds four bytes per call: the low bytes of all offsets in the bin, then the high ones,
    and likewise those of the probabilities, so that a shuffle's compression finds the high ones alike.
    """
    def run(batches):
        tools = np, pa, *_ = _make_tools()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            row, _, pos, hit, ml = _placed(batch, tools)
            row, pos, ml = row[hit], pos[hit], ml[hit].astype(np.int16).view(np.uint16)
            key = row * (np.int64(1) << 32) + pos
            if np.any(key[1:] < key[:-1]):
                order = np.argsort(key, kind="stable")
                row, pos, ml = row[order], pos[order], ml[order]
            place = pos // width
            head = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(place) != 0))[:len(row)])
            bounds = np.append(head, len(row))
            many = np.diff(bounds)
            at = np.arange(len(row)) + np.repeat(3 * head, many)
            offset, step = pos - place * width, np.repeat(many, many)
            packed = np.empty(4 * len(row), np.uint8)
            for k, byte in enumerate((offset & 255, offset >> 8, ml & 255, ml >> 8)):
                packed[at + k * step] = byte
            read = pa.array(row[head])
            yield pa.RecordBatch.from_arrays([
                batch.column("read_key").take(read), batch.column("chrom").take(read),
                pa.array(place[head].astype(np.int32)),
                pa.BinaryArray.from_buffers(pa.binary(), len(head), [
                    None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(packed)]),
            ], names=["read_key", "chrom", "bin", "calls"])

    return run


def keep_on_bin_sites(width):
    """One row per call of ``place_in_bins`` whose position is a site: a set bit of its bin's words
    ``w0``, ``w1`` and so on, of 64 positions each."""
    def run(batches):
        np, pa, _, _, owners, *_ = _make_tools()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = batch.column("calls").cast(pa.large_binary())
            _, ends, data = column.buffers()
            bounds = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
            packed = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]].astype(np.int32)
            bounds = (bounds - bounds[0]) // 4
            many, row = np.diff(bounds), owners(bounds)
            at, step = np.arange(len(row)) + 3 * bounds[row], many[row]
            offset = packed[at] + (packed[at + step] << 8)
            words = np.stack([batch.column(f"w{k}").to_numpy() for k in range(-(-width // 64))], 1)
            keep = np.flatnonzero(words[row, offset >> 6] >> (offset & 63) & 1)
            start = batch.column("bin").to_numpy().astype(np.int64) * width
            row, at, step = row[keep], at[keep], step[keep]
            ml = (packed[at + 2 * step] + (packed[at + 3 * step] << 8)).astype(np.uint16).view(np.int16)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                batch.column("read_key").take(take), batch.column("chrom").take(take),
                pa.array((start[row] + offset[keep]).astype(np.int32)), pa.array(ml),
            ], names=["read_key", "chrom", "pos", "ml"])

    return run


def _on_sites(batch, tools):
    """Calls of the batch whose position is among their row's sorted ``sites``: row, place among the
    sites of all rows, position, probability."""
    np, _, _, lists, owners, *_ = tools
    pos, bounds = lists(batch.column("pos"))
    ml, _ = lists(batch.column("ml"))
    sites, site_bounds = lists(batch.column("sites"))
    stride = np.int64(1) << 32
    row = owners(bounds)
    known, asked = owners(site_bounds) * stride + sites, row * stride + pos
    at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
    keep = np.flatnonzero(known[at] == asked) if len(known) else np.zeros(0, np.int64)
    return row[keep], at[keep], pos[keep].astype(np.int32), ml[keep].astype(np.int16)


def _others(batch):
    return [c for c in batch.schema.names if c not in ("pos", "ml", "sites", "cpg_ids")]


def keep_on_sites(batches):
    """One row per call whose position is among its row's sorted ``sites``, with all other columns."""
    tools = _, pa, *_ = _make_tools()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        row, _, pos, ml = _on_sites(batch, tools)
        names, take = _others(batch), pa.array(row)
        yield pa.RecordBatch.from_arrays([
            *(batch.column(c).take(take) for c in names), pa.array(pos), pa.array(ml),
        ], names=[*names, "pos", "ml"])


def pack_on_sites(batches):
    """The same calls as lists, one row per row that has one."""
    tools = np, pa, *_ = _make_tools()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        row, _, pos, ml = _on_sites(batch, tools)
        head = np.flatnonzero(np.append(True, np.diff(row) != 0)[:len(row)])
        offsets = pa.array(np.append(head, len(row)), pa.int32())
        names, take = _others(batch), pa.array(row[head])
        yield pa.RecordBatch.from_arrays([
            *(batch.column(c).take(take) for c in names),
            pa.ListArray.from_arrays(offsets, pa.array(pos)),
            pa.ListArray.from_arrays(offsets, pa.array(ml)),
        ], names=[*names, "pos", "ml"])


def number_lists_on_sites(batches):
    """The calls of ``number_on_sites`` as lists ``ml`` and ``cpg_id``, one row per row that has one."""
    tools = np, pa, _, lists, *_ = _make_tools()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        row, at, _, ml = _on_sites(batch, tools)
        numbers, _ = lists(batch.column("cpg_ids"))
        head = np.flatnonzero(np.append(True, np.diff(row) != 0)[:len(row)])
        offsets = pa.array(np.append(head, len(row)), pa.int32())
        names, take = _others(batch), pa.array(row[head])
        yield pa.RecordBatch.from_arrays([
            *(batch.column(c).take(take) for c in names),
            pa.ListArray.from_arrays(offsets, pa.array(ml)),
            pa.ListArray.from_arrays(offsets, pa.array(numbers[at].astype("int32"))),
        ], names=[*names, "ml", "cpg_id"])


def words_of_lists(batches):
    """``words, masks, bits`` of rows with lists ``cpg_id`` and ``bin`` (null: not counted): of every 64
    sites those that the row has, and those of them that are 1."""
    np, pa, _, lists, owners, *_ = _make_tools()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        site, bounds = lists(batch.column("cpg_id"))
        state, _ = lists(batch.column("bin"))
        row = owners(bounds)
        known = np.flatnonzero((state == 0) | (state == 1))
        row, site, state = row[known], site[known].astype(np.int64), state[known]
        order = np.lexsort((site, row))
        row, site, state = row[order], site[order], state[order]
        word, bit = site // 64, np.uint64(1) << (site % 64).astype(np.uint64)
        new_row = np.append(True, np.diff(row) != 0)[:len(row)]
        head = np.flatnonzero(new_row | np.append(True, np.diff(word) != 0)[:len(row)])
        if not len(head):
            continue
        masks = np.bitwise_or.reduceat(bit, head)
        bits = np.bitwise_or.reduceat(np.where(state == 1, bit, np.uint64(0)), head)
        first = np.flatnonzero(new_row[head])
        offsets, take = pa.array(np.append(first, len(head)), pa.int32()), pa.array(row[head[first]])
        yield pa.RecordBatch.from_arrays([
            *(batch.column(c).take(take) for c in ("region_id", "read_id")),
            pa.ListArray.from_arrays(offsets, pa.array(word[head].astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(masks.view(np.int64))),
            pa.ListArray.from_arrays(offsets, pa.array(bits.view(np.int64))),
        ], names=["region_id", "read_id", "words", "masks", "bits"])


def number_on_sites(batches):
    """One row per call on a site, as ``keep_on_sites``, with the site's number (``cpg_ids`` holds one
    for every site)."""
    tools = _, pa, _, lists, *_ = _make_tools()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        row, at, pos, ml = _on_sites(batch, tools)
        numbers, _ = lists(batch.column("cpg_ids"))
        names, take = _others(batch), pa.array(row)
        yield pa.RecordBatch.from_arrays([
            *(batch.column(c).take(take) for c in names), pa.array(pos), pa.array(ml),
            pa.array(numbers[at].astype("int32")),
        ], names=[*names, "pos", "ml", "cpg_id"])


def place_blocks(batches):
    """One row per aligned block of each read."""
    np, pa, *_, blocks, _ = _make_tools()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        row, seq_start, ref_start, length = blocks(batch)
        yield pa.RecordBatch.from_arrays([
            batch.column("read_key").take(pa.array(row)),
            pa.array(seq_start.astype(np.int32)),
            pa.array(ref_start.astype(np.int32)),
            pa.array(length.astype(np.int32)),
        ], names=["read_key", "seq_start", "ref_start", "length"])


def _cpg_places(batch, tools):
    """Row and 1-based position of C in every CG whose C lies in the tile's own span, in order."""
    np, _, text, *_ = tools
    raw, bounds = text(batch.column("seq"))
    data = raw[bounds[0]:bounds[-1]]
    at = np.flatnonzero((data[:-1] == ord("C")) & (data[1:] == ord("G")))
    ends = bounds[1:] - bounds[0]
    row = np.searchsorted(ends, at, "right")
    offset = at - (ends[row] - np.diff(bounds)[row])
    core = batch.column("core").to_numpy(zero_copy_only=False)
    keep = (at + 1 < ends[row]) & (offset < core[row])
    row, offset = row[keep], offset[keep]
    first = batch.column("tile_start").to_numpy(zero_copy_only=False)
    return row, (first[row] + offset + 1).astype(np.int32)


def find_cpg(batches):
    """1-based positions of C in every CG whose C lies in the tile's own span."""
    tools = _, pa, *_ = _make_tools()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        row, pos = _cpg_places(batch, tools)
        yield pa.RecordBatch.from_arrays([
            batch.column("chrom").take(pa.array(row)), pa.array(pos),
        ], names=["chrom", "pos"])


def find_cpg_in_bins(width):
    """The same positions as lists, one row per tile and bin of ``width`` bases (the first from 1)."""
    def run(batches):
        tools = np, pa, *_ = _make_tools()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            row, pos = _cpg_places(batch, tools)
            bins = (pos - 1) // width
            head = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(bins) != 0))[:len(row)])
            offsets = pa.array(np.append(head, len(row)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("chrom").take(pa.array(row[head])),
                pa.array(bins[head].astype(np.int32)),
                pa.ListArray.from_arrays(offsets, pa.array(pos)),
            ], names=["chrom", "bin", "sites"])

    return run
