"""Media columns: FLAC streams of 8-bit samples, encoded, decoded and verified in batches.

A payload's bytes, less 128, are samples of one channel. Frames of all streams of a batch are lanes
of the same numpy steps: predictors and Rice codes are written and read for all of them at once, longest
first, so that the cost a sample does not depend on how short the streams are.

The decoder handles constant, verbatim, fixed (orders 0 to 4) and linear-predictor subframes, all Rice
partitionings and the escape code, checks every frame header's CRC-8 and every frame's CRC-16, and
gives PCM blocks with their sample offsets. A seek table entry for every frame makes any sample offset
reachable without the frames before it.

Defined cases: null and empty payloads become 64 zero bytes; equal texts give equal streams; repeated
rows and null ids are handled each by itself; an empty table gives no rows; a damaged stream raises
`CorruptStream`; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import chunks, table, text_or_empty

BLOCK = 4096  # samples of a frame
RATE = 8000
PARTITIONS = 3  # as a power of two
LPC_ORDER, PRECISION = 4, 12


class CorruptStream(ValueError):
    """A stream that is not what its checksums or markers say."""


def _crc_table(polynomial: int, width: int) -> np.ndarray:
    x = np.arange(256, dtype=np.uint32) << np.uint32(width - 8)
    for _ in range(8):
        top = (x >> np.uint32(width - 1)) & np.uint32(1)
        x = (x << np.uint32(1) ^ top * np.uint32(polynomial)) & np.uint32((1 << width) - 1)
    return x


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


#: CRC-16 of two bytes at once.
CRC16_PAIR = (CRC16[(CRC16[np.arange(1 << 16) >> 8] >> np.uint32(8)) ^ (np.arange(1 << 16) & 0xFF)] ^ (CRC16[np.arange(1 << 16) >> 8] << np.uint32(8))).astype(np.uint16)


def _live(sizes: np.ndarray) -> np.ndarray:
    """For every step, the lanes still on; sizes fall."""
    return np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), "left")


def crc8_lanes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-8 of each part of raw."""
    order = np.argsort(-size, kind="stable")
    at, crc = start[order], np.zeros(len(start), np.uint32)
    for t, m in enumerate(_live(size[order])):
        crc[:m] = CRC8[crc[:m] ^ raw[at[:m] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def crc16_lanes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of each part of raw, two bytes a step."""
    order = np.argsort(-(size >> 1), kind="stable")
    at, odd = start[order], size[order] & 1
    crc = np.where(odd == 1, CRC16[raw[at]], 0).astype(np.uint16)
    at = at + odd
    pair = raw[:-1].astype(np.uint16) << np.uint16(8) | raw[1:]
    for t, m in enumerate(_live(size[order] >> 1)):
        crc[:m] = CRC16_PAIR[crc[:m] ^ pair[at[:m] + 2 * t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    for size in range(2, 8):
        if n < 1 << (5 * size + 1):
            tail = [0x80 | (n >> 6 * k) & 0x3F for k in range(size - 2, -1, -1)]
            return bytes([(0xFF << (8 - size)) & 0xFF | n >> 6 * (size - 1), *tail])
    raise ValueError(n)


class _Frames:
    """The frames of some payloads: samples in a row, frame by frame."""

    def __init__(self, payloads: list[bytes]):
        self.samples = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
        sizes = [min(BLOCK, len(p) - a) for p in payloads for a in range(0, len(p), BLOCK)]
        self.size = np.array(sizes, np.int64)
        self.stream = np.repeat(np.arange(len(payloads)), [-(-len(p) // BLOCK) for p in payloads])
        self.number = np.concatenate([np.arange(-(-len(p) // BLOCK)) for p in payloads]) if payloads else np.zeros(0, int)
        self.start = np.cumsum(self.size) - self.size


def _differences(x: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """Residuals of a fixed predictor; the first `order` samples of a frame stay as they are."""
    out = x.copy()
    for k in range(order):
        step = out.copy()
        step[1:] -= out[:-1]
        out = np.where(place > k, step, x)
    return out


def _predictors(f: _Frames, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors and their shifts, by least squares on each frame's lagged products."""
    x = f.samples.astype(float)
    r = np.zeros((LPC_ORDER + 1, len(f.size)))
    for k in range(LPC_ORDER + 1):
        product = x.copy()
        product[k:] *= x[: len(x) - k] if k else x
        product[place < k] = 0
        r[k] = np.add.reduceat(product, f.start)
    lag = np.abs(np.arange(LPC_ORDER)[:, None] - np.arange(LPC_ORDER))
    a = np.transpose(r[lag], (2, 0, 1)) + np.eye(LPC_ORDER) * (r[0][:, None, None] * 1e-3 + 1)
    c = np.linalg.solve(a, r[1:].T[:, :, None])[:, :, 0]
    top = np.maximum(np.abs(c).max(1), 2.0**-10)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(top)).astype(np.int64), 0, 15)
    limit = (1 << PRECISION - 1) - 1
    return np.clip(np.rint(c * 2.0 ** shift[:, None]), -limit, limit).astype(np.int64), shift


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads, whose sizes are positive multiples of 64."""
    if not payloads:
        return []
    f = _Frames(payloads)
    n = len(f.size)
    of = np.repeat(np.arange(n, dtype=np.int32), f.size)
    place = np.arange(len(f.samples), dtype=np.int32) - np.repeat(f.start.astype(np.int32), f.size)
    options = [_differences(f.samples, place, k) for k in range(3)]
    coefs, shift = _predictors(f, place)
    each = lambda values: np.repeat(values.astype(np.int32), f.size)
    guess = np.zeros(len(f.samples), np.int32)
    for k in range(LPC_ORDER):
        guess[k + 1 :] += each(coefs[:, k])[k + 1 :] * f.samples[: -k - 1]
    options.append(np.where(place >= LPC_ORDER, f.samples - (guess >> each(shift)), f.samples))
    orders = np.array([0, 1, 2, LPC_ORDER])
    cost = np.stack([np.add.reduceat(np.abs(r), f.start) for r in options]).astype(float)
    cost = f.size * np.log2(cost / f.size + 0.5)  # about the bits
    cost[3] += 9 + LPC_ORDER * PRECISION
    kind = cost.argmin(0)
    order = orders[kind]
    residual, kinds = options[0], each(kind)
    for j in range(1, 4):
        np.copyto(residual, options[j], where=kinds == j)
    u = residual << 1 ^ residual >> 31
    coded = place >= each(order)
    first = (f.start[:, None] + (f.size >> PARTITIONS)[:, None] * np.arange(1 << PARTITIONS)).ravel()  # a partition's first sample; sizes are multiples of 64
    mean = np.add.reduceat(np.where(coded, u, 0), first) / np.maximum(np.add.reduceat(coded.astype(np.int64), first), 1)
    k = np.clip(np.floor(np.log2(np.maximum(mean, 1))).astype(np.int64), 0, 14)
    parts = np.diff(np.append(first, len(u)))
    k_of = np.repeat(k.astype(np.int32), parts)
    q = u >> k_of
    bits = np.where(coded, q + 1 + k_of, 8)  # a warm-up sample has 8 bits
    heads = [b"\xff\xf8" + b"\x70\x02" + _number(int(i)) + struct.pack(">H", int(s) - 1) for i, s in zip(f.number, f.size)]
    head_size = np.array([len(h) + 1 for h in heads])  # with its CRC-8
    lpc = kind == 3
    before = 8 + np.where(lpc, 9 + LPC_ORDER * PRECISION, 0) + 6  # bits of a subframe outside samples and partitions
    body = np.add.reduceat(bits, f.start) + before + (4 << PARTITIONS)
    frame_size = head_size + -(-body // 8) + 2
    at = np.cumsum(frame_size) - frame_size  # bytes
    out = np.zeros(int(frame_size.sum()) * 8, np.uint8)  # bits

    def put(where: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            out[where + b] = value >> (width - 1 - b) & 1

    sub = (at + head_size) * 8
    put(sub, np.where(lpc, 0x20 | LPC_ORDER - 1, 0x08 | order) << 1, 8)
    # samples: warm-up ones, then (after what stands between) the coded ones, with a parameter before each partition
    ahead = np.cumsum(bits, dtype=np.int64) - bits
    extra = np.repeat(np.repeat(sub + before - ahead[f.start], 1 << PARTITIONS) + np.tile(4 * np.arange(1, (1 << PARTITIONS) + 1), n), parts)
    pos = ahead + extra
    early = np.flatnonzero(~coded)
    pos[early] = ahead[early] + (sub + 8 - ahead[f.start])[of[early]]
    warm = early
    put(pos[warm], f.samples[warm] & 0xFF, 8)
    after = sub + 8 + 8 * order
    if lpc.any():
        w = after[lpc]
        put(w, np.full(len(w), PRECISION - 1), 4)
        put(w + 4, shift[lpc], 5)
        for j in range(LPC_ORDER):
            put(w + 9 + j * PRECISION, coefs[lpc, j] & (1 << PRECISION) - 1, PRECISION)
    put(sub + before + 8 * order - 6, np.full(n, PARTITIONS), 6)
    lead = np.where(coded[first], pos[first], sub[of[first]] + before[of[first]] + 8 * order[of[first]] + 4) - 4
    put(lead, k, 4)
    c = np.flatnonzero(coded) if len(early) else slice(None)
    u, k_of, stop = u[c], k_of[c], pos[c] + q[c]
    out[stop] = 1
    last = stop + k_of
    for b in range(int(k.max(initial=0))):  # bit b, counted from the last, of the remainder
        some = np.flatnonzero((u >> b & 1 == 1) & (k_of > b))
        out[last[some] - b] = 1
    raw = np.packbits(out)
    head = np.frombuffer(b"".join(heads), np.uint8)
    hs = np.cumsum(head_size - 1) - (head_size - 1)
    crc = crc8_lanes(head, hs, head_size - 1)
    raw[np.repeat(at - hs, head_size - 1) + np.arange(len(head))] = head
    raw[at + head_size - 1] = crc
    crc = crc16_lanes(raw, at, frame_size - 2)
    raw[at + frame_size - 2], raw[at + frame_size - 1] = crc >> 8, crc & 0xFF
    data, ends, streams = raw.tobytes(), np.searchsorted(f.stream, np.arange(len(payloads)), "right"), []
    a = 0
    for i, p in enumerate(payloads):
        sizes, b = frame_size[a : ends[i]], int(ends[i])
        md5 = hashlib.md5((np.frombuffer(p, np.uint8) - np.uint8(128)).tobytes()).digest()
        facts = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + md5
        offsets = np.cumsum(sizes) - sizes
        points = b"".join(struct.pack(">QQH", int(j) * BLOCK, int(o), int(s)) for j, (o, s) in enumerate(zip(offsets, f.size[a:b])))
        streams.append(b"fLaC\x00" + len(facts).to_bytes(3, "big") + facts + b"\x83" + len(points).to_bytes(3, "big") + points + data[at[a] : at[b - 1] + frame_size[b - 1]])
        a = b
    return streams


def facts(stream: bytes) -> dict:
    """What the metadata blocks say: samples, bits, md5, seek points [(sample, byte, samples)] and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise CorruptStream("no stream marker")
    at, out = 4, {"seek": []}
    while True:
        kind, size = stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        block, last = stream[at + 4 : at + 4 + size], stream[at] >> 7
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            out |= {"samples": packed & (1 << 36) - 1, "bits": (packed >> 36 & 31) + 1, "channels": (packed >> 41 & 7) + 1, "rate": packed >> 44, "md5": block[18:34]}
        elif kind == 3:
            out["seek"] = [p for p in struct.iter_unpack(">QQH", block) if p[0] != (1 << 64) - 1]
        at += 4 + size
        if last:
            return out | {"frames": at}


class _Reader:
    """Bit positions of many frames over one buffer."""

    def __init__(self, raw: bytes):
        padded = np.frombuffer(raw + bytes(16), np.uint8)
        self.words = np.ndarray((len(padded) - 7,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)

    def peek(self, pos: np.ndarray) -> np.ndarray:
        """At least 56 bits from each position, at the top."""
        return self.words[pos >> 3] << (pos & 7).astype(np.uint64)

    def take(self, pos: np.ndarray, width) -> np.ndarray:
        width = np.asarray(width, np.uint64)
        return np.where(width > 0, self.peek(pos) >> (np.uint64(64) - np.maximum(width, np.uint64(1))), np.uint64(0)).astype(np.int64)


#: Zero bits at the top of 16-bit numbers.
LEADING = (16 - np.ceil(np.log2(np.arange(1 << 16) + 1.0))).astype(np.int64)


def _leading(x: np.ndarray) -> np.ndarray:
    """Zero bits at the top of 64-bit words (64 for none set); only the top 53 bits matter here."""
    short = LEADING[x >> np.uint64(48)]
    if short.max(initial=0) < 16:
        return short
    return np.where(x == 0, 64, 63 - (np.frexp((x >> np.uint64(11)).astype(np.float64))[1] + 10)).astype(np.int64)


def decode_frames(raw: bytes, at: np.ndarray, frame_size: np.ndarray, samples: np.ndarray) -> list[np.ndarray]:
    """Samples of frames that lie at byte positions `at` of raw, all checksums verified."""
    buffer = np.frombuffer(raw, np.uint8)
    check = buffer[at + frame_size - 2].astype(np.uint16) << np.uint16(8) | buffer[at + frame_size - 1]
    if (crc16_lanes(buffer, at, frame_size - 2) != check).any():
        raise CorruptStream("frame checksum")
    if ((buffer[at] != 0xFF) | (buffer[at + 1] & 0xFE != 0xF8)).any():
        raise CorruptStream("no frame marker")
    code = buffer[at + 2] >> 4
    first = buffer[at + 4].astype(np.int64)
    number = np.where(first < 0x80, 1, 8 - np.floor(np.log2(np.maximum((~first & 0xFF), 1))).astype(np.int64) - 1)
    head = 4 + number + np.select([code == 6, code == 7], [1, 2], 0)
    if (crc8_lanes(buffer, at, head) != buffer[at + head]).any():
        raise CorruptStream("header checksum")
    order_of = np.argsort(-samples, kind="stable")
    at, n = at[order_of], samples[order_of]
    r, pos = _Reader(raw), (at + head[order_of] + 1) * 8
    lanes, top = len(at), int(n.max(initial=0))
    kind = r.take(pos, 8) >> 1 & 0x3F
    pos = pos + 8
    x = np.zeros((top, lanes), np.int64)
    signed = lambda v, w: v - ((v >> (w - 1) & 1) << w)
    constant, verbatim, fixed, lpc = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | lpc).all():
        raise CorruptStream("reserved subframe")
    order = np.select([fixed, lpc], [kind - 8, kind - 31], 0)
    live = np.searchsorted(-n, -np.arange(top), "left")
    for t in range(int(order.max(initial=0))):
        w = order > t
        x[t, w] = signed(r.take(pos[w], 8), 8)
        pos[w] += 8
    x[:, constant] = signed(r.take(pos[constant], 8), 8)
    for t in range(top if verbatim.any() else 0):
        w = np.flatnonzero(verbatim[: live[t]])
        x[t, w] = signed(r.take(pos[w], 8), 8)
        pos[w] += 8
    coefs, shift = np.zeros((32, lanes), np.int64), np.zeros(lanes, np.int64)
    if lpc.any():
        w = np.flatnonzero(lpc)
        precision = r.take(pos[w], 4) + 1
        shift[w] = signed(r.take(pos[w] + 4, 5), 5)
        pos[w] += 9
        for j in range(int(order[w].max())):
            more = order[w] > j
            v = r.take(pos[w[more]], precision[more])
            coefs[j, w[more]] = v - ((v >> (precision[more] - 1) & 1) << precision[more])
            pos[w[more]] += precision[more]
    coded = fixed | lpc
    wide = np.where(r.take(pos, 2) == 1, 5, 4)
    parts = np.where(coded, r.take(pos + 2, 4), 0)
    pos = np.where(coded, pos + 6, pos)
    length = np.maximum(n >> parts, 1)
    k, escape, escapes = np.zeros(lanes, np.int64), np.zeros(lanes, bool), False
    due = np.where(coded, order, -1)  # the next coded sample that a partition's parameter stands before
    all_on = int(order.max(initial=0)) if coded.all() else top
    for t in range(top):
        m = live[t]
        w = np.flatnonzero(due[:m] == t)
        if len(w):
            due[w] = (t // length[w] + 1) * length[w]
            k[w] = r.take(pos[w], wide[w])
            pos[w] += wide[w]
            escape[w] = k[w] == (1 << wide[w]) - 1
            e = w[escape[w]]
            escapes = escapes or len(e) > 0
            if len(e):
                k[e] = r.take(pos[e], 5)
                pos[e] += 5
        w = slice(0, m) if t >= all_on else np.flatnonzero(coded[:m] & (t >= order[:m]))
        if isinstance(w, np.ndarray) and not len(w):
            continue
        p, kk = pos[w], k[w]
        word = r.peek(p)
        q = _leading(word)
        step = q + 1 + kk
        # the code's bits after the zeros are its stop bit and the remainder
        rest = (word >> (64 - np.minimum(step, 64)).astype(np.uint64)).view(np.int64) & (1 << kk) - 1
        for i in np.flatnonzero(step > 52) if step.max() > 52 else ():  # long codes, bit by bit
            zeros = 0
            while not int(r.take(p[i : i + 1] + zeros, 1)[0]):
                zeros += 1
            q[i], rest[i] = zeros, int(r.take(p[i : i + 1] + zeros + 1, kk[i : i + 1])[0])
        u = q << kk | rest
        value = (u >> 1) ^ -(u & 1)
        step = q + 1 + kk
        if escapes and escape[w].any():
            e = escape[w]
            v = r.take(p, kk)
            value = np.where(e, np.where(kk > 0, v - ((v >> np.maximum(kk - 1, 0) & 1) << kk), 0), value)
            step = np.where(e, kk, step)
        x[t, w] = value
        pos[w] = p + step
    for o in range(1, 5):
        w = np.flatnonzero(fixed & (order == o))
        if len(w):
            x[:, w] = _undo(x[:, w], o)
    for o in np.unique(order[lpc]):
        w = np.flatnonzero(lpc & (order == o))
        y, c, s = x[:, w], coefs[:o, w], shift[w]
        for t in range(int(o), top):
            y[t] += (c * y[t - int(o) : t][::-1]).sum(0) >> s
        x[:, w] = y
    out: list = [None] * lanes
    for i, j in enumerate(order_of):
        out[j] = x[: n[i], i]
    return out


def _undo(x: np.ndarray, order: int) -> np.ndarray:
    """Samples from the residuals of a fixed predictor (rows are times): sums of sums, begun from the warm-up."""
    warm = x[:order].copy()
    levels = [warm]
    for _ in range(order - 1):
        levels.append(np.diff(levels[-1], axis=0))
    rest = x[order:]
    for level in range(order - 1, -1, -1):
        rest = np.cumsum(np.concatenate([levels[level][-1:], rest]), axis=0)[1:]
    return np.concatenate([warm, rest])


def read_streams(streams: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """The PCM blocks (sample offset, samples) of every stream; its MD5 is verified too."""
    at, size, samples, told = [], [], [], [facts(s) for s in streams]
    base = 0
    for s, f in zip(streams, told):
        begin = [p[1] for p in f["seek"]]
        end = begin[1:] + [len(s) - f["frames"]]
        at += [base + f["frames"] + b for b in begin]
        size += [e - b for b, e in zip(begin, end)]
        samples += [p[2] for p in f["seek"]]
        base += len(s)
    blocks = iter(decode_frames(b"".join(streams), np.array(at, np.int64), np.array(size, np.int64), np.array(samples, np.int64)))
    out = [[(p[0], next(blocks)) for p in f["seek"]] for f in told]
    for f, parts in zip(told, out):
        if hashlib.md5(b"".join(p.astype(np.int8).tobytes() for _, p in parts)).digest() != f["md5"]:
            raise CorruptStream("stream checksum")
    return out


def read_samples(stream: bytes, offset: int, count: int) -> np.ndarray:
    """Some samples, by way of the seek table: only the frames that hold them are decoded."""
    f = facts(stream)
    ends = [p[1] for p in f["seek"][1:]] + [len(stream) - f["frames"]]
    need = [(p, e) for p, e in zip(f["seek"], ends) if p[0] < offset + count and p[0] + p[2] > offset]
    if not need:
        return np.zeros(0, np.int64)
    got = np.concatenate(decode_frames(stream, np.array([f["frames"] + p[1] for p, _ in need]), np.array([e - p[1] for p, e in need]), np.array([p[2] for p, _ in need])))
    return got[offset - need[0][0][0] :][:count]


def payload_of(text: bytes) -> bytes:
    """A text padded with zero bytes to a positive multiple of 64."""
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def features(samples: np.ndarray) -> str:
    """Mean, root mean square, zero crossings and peak of some samples."""
    signs = np.signbit(samples)
    return f"mean={samples.mean():.4f};rms={np.sqrt((samples.astype(float) ** 2).mean()):.4f};crossings={int((signs[1:] != signs[:-1]).sum())};peak={int(np.abs(samples).max())}"


def media(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text's FLAC stream."""

    def run(batches):
        for cols, texts in chunks(batches, "text", 1 << 21):
            yield pa.RecordBatch.from_arrays([pa.array(cols["id"], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode([payload_of(t) for t in texts]), pa.binary())], ["id", "n_bytes", "media"])

    return docs.select(F.col(id).cast("long").alias("id"), text_or_empty(text).alias("text")).mapInArrow(run, "id long, n_bytes long, media binary").withColumnRenamed("id", id)


def pcm_blocks(streams: DataFrame, *, id: str = "doc_id", media: str = "media") -> DataFrame:
    """(id, block, sample_offset, n_samples, pcm): the decoded blocks of every stream, as signed 8-bit samples."""

    def run(batches):
        for cols, raw in chunks(batches, "media", 1 << 21):
            rows = [(i, b, offset, len(x), x.astype(np.int8).tobytes()) for i, blocks in zip(cols["id"], read_streams(raw)) for b, (offset, x) in enumerate(blocks)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])], ["id", "block", "sample_offset", "n_samples", "pcm"])

    return streams.select(F.col(id).cast("long").alias("id"), F.col(media).alias("media")).mapInArrow(run, "id long, block long, sample_offset long, n_samples long, pcm binary").withColumnRenamed("id", id)


def digests(streams: DataFrame, *, id: str = "doc_id") -> DataFrame:
    """What the stored streams hold, from their bytes read back and decoded."""
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for cols, raw in chunks(batches, "media", 1 << 21):
            out: list[list] = [[] for _ in names]
            for i, n, stream, blocks in zip(cols["id"], cols["n_bytes"], raw, read_streams(raw)):
                samples = np.concatenate([x for _, x in blocks])
                payload = (samples + 128).astype(np.uint8).tobytes()
                for column, v in zip(out, (i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), features(samples))):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return streams.select(F.col(id).alias("id"), "n_bytes", "media").mapInArrow(run, schema).withColumnRenamed("id", id)


def op6_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(media(table(spark, sf_dir, "documents")))
