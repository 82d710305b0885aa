"""Media columns: progressive JPEG.

Decoding accumulates the scans of a progressive file, by spectral selection and successive approximation, into coefficient
arrays, transforms them back in numpy, upsamples chroma and gives a full-resolution RGB tensor. ``decode_file`` reads any
8-bit Huffman-coded progressive file, symbol by symbol. Many files of one shape whose scans each use a table of a single
symbol have their bits at fixed places: ``decode_many`` reads those as arrays, and falls back to ``decode_file``.

A payload is stored losslessly in the format's unit, the quantised coefficient: each 64 bytes become the 64 coefficients of
a block, as 256 + byte, so that all have the same magnitude category and each scan needs one Huffman symbol. The file has
4:2:0 chroma and these scans for each component: first DC bits (restarted at each block, so that no prediction is needed),
DC refinement, and for the bands 1-5 and 6-63 first bits and refinement. The payload's true length is in a comment.

Rows are handled in batches of bounded bytes; a very long payload is one file and a batch of its own. Cases: null payload is empty; the empty payload is padded to one block of zero bytes, like any other. Equal payloads give
equal files. A column of broken files raises ValueError. Columns with the names of new ones are replaced.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Natural index of each coefficient in zigzag order, by the rule of the standard.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) if (i // 8 + i % 8) % 2 else (i % 8))))
BANDS = ((1, 5), (6, 63))
SCALE = 1 << 13
PIECE = 1 << 20
_STOP = re.compile(rb"\xff[^\x00\xd0-\xd7]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _basis() -> np.ndarray:
    """64 x 64 integers (as doubles): coefficients in zigzag order to samples, times SCALE; sums stay exact."""
    k = np.arange(8)
    c = np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16)
    full = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return np.rint(full[ZIGZAG] * SCALE)


BASIS = _basis()


def samples(coefs: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(n, 64) quantised coefficients in zigzag order to (n, 8, 8) samples."""
    flat = (coefs.astype(np.float64) * quant) @ BASIS
    return np.clip(np.floor_divide(flat + SCALE // 2, SCALE) + 128, 0, 255).astype(np.uint8).reshape(-1, 8, 8)


def rgb_of(planes: list[np.ndarray], height: int, width: int) -> np.ndarray:
    """Planes (files, h, w) of Y or Y, Cb, Cr to (files, 3, height, width); chroma is repeated up to the size of Y."""

    def full(plane: np.ndarray) -> np.ndarray:
        v, h = -(-planes[0].shape[-2] // plane.shape[-2]), -(-planes[0].shape[-1] // plane.shape[-1])
        plane = plane if (v, h) == (1, 1) else plane.repeat(v, axis=-2).repeat(h, axis=-1)
        return plane[..., :height, :width]

    y = full(planes[0]).astype(np.int16)
    out = np.empty((len(y), 3, height, width), np.uint8)
    if len(planes) == 1:
        out[:] = y[:, None]
        return out
    cb, cr = planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    half = 1 << 15  # fixed-point factors of 1.402, 0.344136, 0.714136, 1.772
    r, b = (91881 * cr + half) >> 16, (116130 * cb + half) >> 16
    g = (-22554 * cb - 46802 * cr + half) >> 16
    for i, part in enumerate((r, g, b)):
        out[:, i] = np.clip(y + full(part.astype(np.int16)), 0, 255)
    return out


# --- writing ---------------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def shape_of(blocks: int) -> tuple[int, int]:
    """(columns, rows) of the 16 x 16 units that hold so many blocks, six each."""
    units = -(-blocks // 6)
    columns = min(units, max(64, -(-units // 4095)))
    return columns, -(-units // columns)


def _dht(table: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([table, 1, *[0] * 15, symbol]))


def _pack(bits: np.ndarray) -> np.ndarray:
    """(files, bits) to bytes, filled up with ones."""
    fill = np.ones((len(bits), -bits.shape[1] % 8), np.uint8)
    return np.packbits(np.concatenate([bits, fill], axis=1), axis=1)


def _sos(component: int, ss: int, se: int, ah: int, al: int) -> bytes:
    """Refinement of a band uses the second AC table."""
    return _segment(0xDA, bytes([1, component, 1 if ss and ah else 0, ss, se, ah << 4 | al]))


def encode_many(payloads: np.ndarray, lengths: list[int]) -> list[bytes]:
    """Files of payloads with the same number of blocks, (files, blocks, 64) bytes."""
    files, blocks, _ = payloads.shape
    columns, rows = shape_of(blocks)
    units = columns * rows
    body = np.zeros((files, units * 6, 64), np.uint8)
    body[:, :blocks] = payloads
    counts, at, parts = (4 * units, units, units), 0, []
    stuffed = lambda packed: [row.tobytes().replace(b"\xff", b"\xff\x00") for row in packed]
    restarted: list[tuple[bytes, list[bytes]]] = []
    scans: list[tuple[bytes, list[bytes]]] = []
    for c, n in enumerate(counts, 1):
        part = body[:, at : at + n]
        at += n
        dc = part[:, :, 0]  # the value less 256; its first 8 bits are 1 and the upper 7 of these
        first = dc >> 1 | 0x80
        code = np.zeros((files, n, 16), np.uint8)
        code[:, :, 1:9] = np.unpackbits(first[:, :, None], axis=2)
        code[:, :, 9:] = 1
        code = np.packbits(code, axis=2)
        last = np.array([0xFF, 0], np.uint8)
        marks = (0xD0 + np.arange(n) % 8).astype(np.uint8)
        line = np.empty((files, n, 5), np.uint8)
        line[:, :, :2], line[:, :, 2], line[:, :, 3], line[:, :, 4] = code, 0, last[0], marks
        keep = np.ones(line.shape, bool)
        keep[:, :, 2] = code[:, :, 1] == 0xFF
        keep[:, -1, 3:] = False
        restarted.append((_sos(c, 0, 0, 0, 1), [line[i][keep[i]].tobytes() for i in range(files)]))
        scans.append((_sos(c, 0, 0, 1, 0), stuffed(_pack(dc & 1))))
        for ss, se in BANDS:
            band = part[:, :, ss : se + 1]
            bits = np.zeros((*band.shape, 9), np.uint8)
            bits[..., 1:] = np.unpackbits((band >> 1 | 0x80)[..., None], axis=-1)
            scans.append((_sos(c, ss, se, 0, 1), stuffed(_pack(bits.reshape(files, -1)))))
            bits = np.zeros((files, n, se - ss + 2), np.uint8)
            bits[:, :, 1:] = band & 1
            scans.append((_sos(c, ss, se, 1, 0), stuffed(_pack(bits.reshape(files, -1)))))
    height, width = rows * 16, columns * 16
    frame = _segment(0xDB, bytes([0]) + bytes([1]) * 64) + _segment(0xC2, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    frame += _dht(0, 8) + _dht(0x10, 8) + _dht(0x11, 0) + _segment(0xDD, b"\x00\x01")
    scans[0] = _segment(0xDD, b"\x00\x00") + scans[0][0], scans[0][1]
    return [b"".join([b"\xff\xd8", _segment(0xFE, b"payload %d" % lengths[i]), frame, *(x for head, data in restarted + scans for x in (head, data[i])), b"\xff\xd9"]) for i in range(files)]


# --- reading ---------------------------------------------------------------------------------------------------------


def parse(data: bytes) -> dict:
    """Frame, tables and scans of a file, scans still coded."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    at, quant, huffman, restart = 2, {}, {}, 0
    out: dict = {"scans": [], "comment": b"", "quant": quant}
    while data[at + 1] != 0xD9:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8:
                raise ValueError("8-bit samples only")
            out |= {"height": height, "width": width, "components": {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}}
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("progressive Huffman files only")
        elif marker == 0xDD:
            restart = int.from_bytes(body)
        elif marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDA:
            n = body[0]
            end = _STOP.search(data, at)
            stop = end.start() if end else len(data)
            ss, se, a = body[1 + 2 * n : 4 + 2 * n]
            ids = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(n)]
            tables = tuple(huffman.get(t >> 4) if ss == 0 else huffman.get(16 | t & 15) for _, t in ids)
            out["scans"].append((tuple(i for i, _ in ids), ss, se, a >> 4, a & 15, restart, tables, data[at:stop]))
            at = stop
    return out


class _Bits:
    """Bits of one restart segment, and Huffman symbols of them."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | (self.bits[self.at] if self.at < len(self.bits) else 1)
            self.at += 1
        return out

    def symbol(self, codes: dict) -> int:
        code = 1
        for _ in range(16):
            code = code << 1 | self.take(1)
            if code in codes:
                return codes[code]
        raise ValueError("broken Huffman code")

    def value(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _codes(table: tuple[bytes, bytes]) -> dict:
    """Codes with a leading 1 to symbols."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out[1 << length | code] = table[1][at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _ac_first(bits: _Bits, block: np.ndarray, ss: int, se: int, al: int, codes: dict, run: int) -> int:
    if run:
        return run - 1
    k = ss
    while k <= se:
        r, s = divmod(bits.symbol(codes), 16)
        if s:
            k += r
            block[k] = bits.value(s) * (1 << al)
            k += 1
        elif r == 15:
            k += 16
        else:
            return (1 << r) + bits.take(r) - 1
    return 0


def _ac_refine(bits: _Bits, block: np.ndarray, ss: int, se: int, al: int, codes: dict, run: int) -> int:
    one = 1 << al

    def correct(k: int) -> None:
        if bits.take(1) and not abs(int(block[k])) & one:
            block[k] += one if block[k] > 0 else -one

    k = ss
    while k <= se and not run:
        r, s = divmod(bits.symbol(codes), 16)
        new = 0
        if s:
            new = one if bits.take(1) else -one
        elif r < 15:
            run = (1 << r) + bits.take(r)
            break
        while k <= se:
            if block[k]:
                correct(k)
            elif r:
                r -= 1
            else:
                block[k] = new
                k += 1
                break
            k += 1
    if run:
        for j in range(k, se + 1):
            if block[j]:
                correct(j)
        return run - 1
    return 0


def decode_file(data: bytes) -> tuple[dict, dict[int, np.ndarray]]:
    """(parsed file, component -> coefficients (block rows, block columns, 64) in zigzag order)."""
    f = parse(data)
    comps = f["components"]
    hmax, vmax = max(c[0] for c in comps.values()), max(c[1] for c in comps.values())
    across, down = -(-f["width"] // (8 * hmax)), -(-f["height"] // (8 * vmax))
    coefs = {i: np.zeros((down * v, across * h, 64), np.int32) for i, (h, v, _) in comps.items()}
    for ids, ss, se, ah, al, restart, tables, coded in f["scans"]:
        if len(ids) == 1:
            h, v, _ = comps[ids[0]]
            wide, high = -(-(-(-f["width"] * h // hmax)) // 8), -(-(-(-f["height"] * v // vmax)) // 8)
            units = [[(0, ids[0], y, x)] for y in range(high) for x in range(wide)]
        else:
            units = [[(n, i, y * comps[i][1] + dy, x * comps[i][0] + dx) for n, i in enumerate(ids) for dy in range(comps[i][1]) for dx in range(comps[i][0])] for y in range(down) for x in range(across)]
        codes = [_codes(t) if t else {} for t in tables]
        segments = _RESTART.split(coded) if restart else [coded]
        step = restart or len(units)
        for n, segment in enumerate(segments):
            bits, run, before = _Bits(segment), 0, dict.fromkeys(ids, 0)
            for unit in units[n * step : (n + 1) * step]:
                for table, i, y, x in unit:
                    block = coefs[i][y, x]
                    if ss == 0 and ah == 0:
                        before[i] += bits.value(bits.symbol(codes[table]))
                        block[0] = before[i] * (1 << al)
                    elif ss == 0:
                        block[0] |= bits.take(1) << al
                    elif ah == 0:
                        run = _ac_first(bits, block, ss, se, al, codes[table], run)
                    else:
                        run = _ac_refine(bits, block, ss, se, al, codes[table], run)
    return f, coefs


def _fixed(f: dict) -> bool:
    """Whether all scans have their bits at fixed places: one component, one symbol, values of one magnitude, bands refined once."""
    seen = set()
    for ids, ss, se, ah, al, restart, tables, _ in f["scans"]:
        one = tables[0] is not None and tables[0][0][0] == 1 and len(tables[0][1]) == 1
        symbol = tables[0][1][0] if one else None
        if len(ids) != 1 or (ss == 0) != (se == 0):
            return False
        if ss == 0 and not (restart == 1 and one and symbol and al == 1 if ah == 0 else restart == 0 and (ah, al) == (1, 0) and (ids[0], 0) in seen):
            return False
        if ss and not (restart == 0 and one and (0 < symbol < 16 and al == 1 if ah == 0 else symbol == 0 and (ah, al) == (1, 0) and (ids[0], ss, se) in seen)):
            return False
        if ah == 0:
            seen.add((ids[0], 0) if ss == 0 else (ids[0], ss, se))
    return f["width"] % 16 == 0 == f["height"] % 16 and [c[:2] for c in f["components"].values()] == [(2, 2), (1, 1), (1, 1)]


def _read_fixed(group: list[dict]) -> dict[int, np.ndarray] | None:
    """Coefficients (files, blocks, 64) of files of one shape with fixed places; None if one is not so after all."""
    head, files = group[0], len(group)
    units = head["width"] * head["height"] // 256
    coefs = {i: np.zeros((files, units * h * v, 64), np.int16) for i, (h, v, _) in head["components"].items()}
    for s, (ids, ss, se, ah, _, restart, tables, _) in enumerate(head["scans"]):
        out, n, width = coefs[ids[0]], coefs[ids[0]].shape[1], se - ss + 1
        size = tables[0][1][0] if tables[0] and ah == 0 else 0
        per = 1 if ss == 0 and ah else (1 + width if ah else width * (1 + size))
        raw = [f["scans"][s][7] for f in group]
        raw = [(_RESTART.sub(b"", x) if restart else x).replace(b"\xff\x00", b"\xff") for x in raw]
        need = n * (-(-per // 8)) if restart else -(-n * per // 8)
        if any(len(x) != need for x in raw):
            return None
        data = np.frombuffer(b"".join(raw), np.uint8).reshape(files, -1)
        bits = np.unpackbits(data.reshape(files, n, -1), axis=2)[:, :, :per] if restart else np.unpackbits(data, axis=1)[:, : n * per].reshape(files, n, per)
        if ah == 0:
            bits = bits.reshape(files, n, width, 1 + size)
            if bits[..., 0].any() or not bits[..., 1].all() or size > 8:
                return None
            value = np.packbits(bits[..., 1:], axis=-1)[..., 0] >> (8 - size)
            out[:, :, ss : se + 1] = value.astype(np.int16) << 1
        elif ss == 0:
            out[:, :, 0] |= bits[:, :, 0]
        else:
            if bits[:, :, 0].any():
                return None
            out[:, :, ss : se + 1] |= bits[:, :, 1:]
    return coefs


def _planes(coefs: np.ndarray, quant: np.ndarray, across: int) -> np.ndarray:
    """(files, blocks, 64) to (files, h, w)."""
    files, n, _ = coefs.shape
    s = samples(coefs.reshape(-1, 64), quant).reshape(files, n // across, across, 8, 8)
    return s.transpose(0, 1, 3, 2, 4).reshape(files, n // across * 8, across * 8)


def decode_many(files: list[bytes]) -> Iterator[tuple[int, dict, dict[int, np.ndarray], np.ndarray, str]]:
    """(position, parsed file, component -> (blocks, 64) coefficients, RGB as (3, height, width), feature), in any order."""
    groups: dict = defaultdict(list)
    for i, data in enumerate(files):
        f = parse(data)
        script = tuple((ids, ss, se, ah, al, r, t) for ids, ss, se, ah, al, r, t, _ in f["scans"]) if _fixed(f) else i
        groups[f["height"], f["width"], script].append((i, f))
    for (height, width, script), members in groups.items():
        step = max(1, (PIECE // 2) // (height * width))
        for at in range(0, len(members), step):
            part = members[at : at + step]
            coefs = _read_fixed([f for _, f in part]) if script != part[0][0] else None
            if coefs is None:
                for i, _ in part:
                    f, found = decode_file(files[i])
                    planes = [_planes(c.reshape(1, -1, 64), f["quant"][f["components"][n][2]], c.shape[1]) for n, c in found.items()]
                    tensors = rgb_of(planes, f["height"], f["width"])
                    yield i, f, {n: c.reshape(-1, 64) for n, c in found.items()}, tensors[0], features_of(tensors)[0]
                continue
            comps = part[0][1]["components"]
            planes = [_planes(c, part[0][1]["quant"][comps[n][2]], width // 8 * comps[n][0] // 2) for n, c in coefs.items()]
            tensors = rgb_of(planes, height, width)
            features = features_of(tensors)
            for j, (i, f) in enumerate(part):
                yield i, f, {n: c[j] for n, c in coefs.items()}, tensors[j], features[j]


def features_of(rgb: np.ndarray) -> list[str]:
    """Of (files, 3, h, w): size, mean of each channel in thousandths, and which of 8 x 8 fields are brighter than the mean."""
    _, _, h, w = rgb.shape
    gray = rgb[:, 0].astype(np.int32) + rgb[:, 1] + rgb[:, 2]
    rows, columns = np.linspace(0, h, 9).astype(int)[:-1], np.linspace(0, w, 9).astype(int)[:-1]
    field = np.add.reduceat(np.add.reduceat(gray, rows, axis=1, dtype=np.int64), columns, axis=2)
    bright = np.packbits((field * 64 > field.sum(axis=(1, 2), keepdims=True)).reshape(len(rgb), 64), axis=1)
    means = rgb.reshape(len(rgb), 3, -1).sum(axis=2, dtype=np.int64) * 1000 // (h * w)
    return [f"{w}x{h}:{m[0]},{m[1]},{m[2]}:{x.tobytes().hex()}" for m, x in zip(means.tolist(), bright, strict=True)]


# --- columns ---------------------------------------------------------------------------------------------------------


def _extended(df: DataFrame, new: dict[str, str]) -> tuple[DataFrame, str]:
    kept = df.drop(*new)
    old = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return kept, ", ".join([*old, *(f"`{k}` {v}" for k, v in new.items())])


def _small(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``PIECE`` bytes of a binary column, one row at least."""
    for batch in batches:
        sizes = np.cumsum([0 if x is None else x for x in pc.binary_length(batch.column(name)).to_pylist()])
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PIECE, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def store_media(df: DataFrame, payload: str = "payload") -> DataFrame:
    """``df`` with ``media`` (the file of the payload) and ``n_bytes`` (the payload's length)."""
    kept, schema = _extended(df, {"n_bytes": "bigint", "media": "binary"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, payload):
            rows = [x or b"" for x in batch.column(payload).to_pylist()]
            groups: dict[int, list[int]] = defaultdict(list)
            for i, x in enumerate(rows):
                groups[max(1, -(-len(x) // 64))].append(i)
            media: list = [None] * len(rows)
            for blocks, members in groups.items():
                step = max(1, PIECE // (blocks * 64 * 8))
                for at in range(0, len(members), step):
                    part = members[at : at + step]
                    data = np.frombuffer(b"".join(rows[i].ljust(blocks * 64, b"\0") for i in part), np.uint8).reshape(len(part), blocks, 64)
                    for i, x in zip(part, encode_many(data, [len(rows[i]) for i in part]), strict=True):
                        media[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in rows], pa.int64()), pa.array(media, pa.binary())], [*batch.schema.names, "n_bytes", "media"])

    return kept.mapInArrow(run, schema)


def read_media(df: DataFrame, media: str = "media", payload: bool = True, tensor: bool = True) -> DataFrame:
    """``df`` with height, width, feature and, if wanted, ``rgb`` (height x width x 3 bytes) and the stored ``stored`` payload.

    ``stored`` is the padded payload, null for files that ``store_media`` did not write.
    """
    new = {"height": "int", "width": "int", "feature": "string"} | ({"rgb": "binary"} if tensor else {}) | ({"stored": "binary"} if payload else {})
    kept, schema = _extended(df, new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, media):
            files = batch.column(media).to_pylist()
            out: dict[str, list] = {k: [None] * len(files) for k in new}
            for i, f, coefs, rgb, feature in decode_many(files):
                out["height"][i], out["width"][i], out["feature"][i] = f["height"], f["width"], feature
                if tensor:
                    out["rgb"][i] = np.moveaxis(rgb, 0, -1).tobytes()
                if payload and (m := re.fullmatch(rb"payload (\d+)", f["comment"])):
                    blocks = np.concatenate([coefs[c] for c in f["components"]])
                    out["stored"][i] = (blocks.reshape(-1)[: max(1, -(-int(m[1]) // 64)) * 64] - 256).astype(np.uint8).tobytes()
            kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[k], kinds[v]) for k, v in new.items())], [*batch.schema.names, *new])

    return kept.mapInArrow(run, schema)


def text_payload(text):
    return F.coalesce(text, F.lit("")).cast("binary")
