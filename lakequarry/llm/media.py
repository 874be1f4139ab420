"""Telephony audio in media columns: WAV files of mu-law, A-law or ADPCM samples, decoded and resampled to 16-bit PCM.

mu-law and A-law bytes are expanded by tables of 256 entries, built from the companding rule. ADPCM blocks of 64 bytes are decoded
with numpy across all blocks of a batch at once: the 120 steps within a block are a loop, the blocks are the vector.
Samples are whole numbers throughout, so results do not depend on the machine. Files are decoded in batches of bounded bytes; a task holds
one batch and one long file at most.

Defined results: null payloads are stored as empty ones, and an empty one gets the padding of one unit. A media value that is null or no such WAV
file is decoded to nulls. Equal payloads give equal values. An empty table gives an empty result; repeated rows stay. Payloads of any length are stored and decoded whole. Columns of any names are carried, but those that a function makes (codec and media;
payload, pcm and the features), which its results replace.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, whole_text

UNIT = 64
CODECS = ("ulaw", "alaw", "adpcm")
FORMATS = {"ulaw": 7, "alaw": 6, "adpcm": 0x11}
RATE, PCM_RATE = 8000, 16000

# The step sizes and index changes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282,
    1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
    10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX_CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _ulaw_table() -> np.ndarray:
    u = 255 - np.arange(256)
    size = (((u & 15) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    part, segment = (a & 15) << 4, (a >> 4) & 7
    size = np.where(segment == 0, part + 8, part + 264 << np.maximum(segment - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


TABLES = {"ulaw": _ulaw_table(), "alaw": _alaw_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, 64) bytes to (blocks, 121) samples: a head of sample, step index and a spare byte, then nibbles, low one first."""
    out = np.empty((121, len(blocks)), np.int16)
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = sample
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(120):
        nibble = (data[k // 2] >> 4 * (k % 2)) & 15
        step = STEPS[index]
        change = step >> 3
        change += np.where(nibble & 4, step, 0)
        change += np.where(nibble & 2, step >> 1, 0)
        change += np.where(nibble & 1, step >> 2, 0)
        sample += np.where(nibble & 8, -change, change)
        np.clip(sample, -32768, 32767, out=sample)
        index += INDEX_CHANGES[nibble]
        np.clip(index, 0, 88, out=index)
        out[k + 1] = sample
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at another rate: doubled by a six-tap half-band filter, else by straight lines between samples; ends are held."""
    if rate == to or not len(pcm):
        return pcm
    if to == 2 * rate:
        x = np.pad(pcm.astype(np.int32), (2, 3), "edge")
        n = len(pcm)
        between = (x[:n] - 5 * x[1 : n + 1] + 20 * (x[2 : n + 2] + x[3 : n + 3]) - 5 * x[4 : n + 4] + x[5 : n + 5] + 16) >> 5
        out = np.empty(2 * n, np.int16)
        out[::2], out[1::2] = pcm, np.clip(between, -32768, 32767)
        return out
    at = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    low = at // to
    high = np.minimum(low + 1, len(pcm) - 1)
    a, b = pcm[low].astype(np.int64), pcm[high].astype(np.int64)
    return (a + ((b - a) * (at % to)) // to).astype(np.int16)


def wav(codec: str, data: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of the codec's bytes."""
    if codec == "adpcm":
        form = struct.pack("<HHIIHHHH", FORMATS[codec], 1, rate, rate * UNIT // 121, UNIT, 4, 2, 121)
        fact = len(data) // UNIT * 121
    else:
        form = struct.pack("<HHIIHHH", FORMATS[codec], 1, rate, rate, 1, 8, 0)
        fact = len(data)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, fact) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(file: bytes | None) -> tuple[str, int, bytes] | None:
    """(codec, rate, data) of a mono telephony WAV file; None for anything else."""
    if not file or file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        return None
    at, codec, rate = 12, None, 0
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt " and size >= 16:
            tag, channels, rate = struct.unpack_from("<HHI", file, at + 8)
            codec = next((c for c, f in FORMATS.items() if f == tag and channels == 1), None)
        elif name == b"data":
            data = file[at + 8 : at + 8 + size]
            whole = len(data) == size and (codec != "adpcm" or size % UNIT == 0)
            return (codec, rate, data) if codec and whole else None
        at += 8 + size + size % 2
    return None


def store_media(rows: DataFrame) -> DataFrame:
    """rows (payload: binary, and any others) with codec and media instead of payload: the payload, padded by bytes 0, in a WAV file.

    The codec follows from the payload's bytes, so that equal payloads get equal files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index("payload")
            for part in _parts(b, at):
                codecs, files = [], []
                for p in part.column(at).to_pylist():
                    data = (p or b"") + bytes(UNIT - len(p) % UNIT if p and len(p) % UNIT else 0 if p else UNIT)
                    codecs.append(CODECS[zlib.crc32(data) % 3])
                    files.append(wav(codecs[-1], data))
                kept = [k for k in range(part.num_columns) if k != at]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(codecs, pa.string()), pa.array(files, pa.binary())], [*(part.schema.names[k] for k in kept), "codec", "media"])

    rows = rows.drop("codec", "media")
    return rows.mapInArrow(run, _schema(rows, "payload", "codec string, media binary"))


def decode_media(rows: DataFrame, to: int = PCM_RATE) -> DataFrame:
    """rows with, from their column media: payload (bytes read back), pcm (16-bit samples at the rate to) and n_samples, peak, sum_abs, zero_crossings."""
    names = ("payload", "pcm", "n_samples", "peak", "sum_abs", "zero_crossings")
    kinds = (pa.binary(), pa.binary(), *[pa.int64()] * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, b.schema.names.index("media")):
                found = [read_wav(f) for f in part.column("media").to_pylist()]
                own = [x for x in found if x]
                coded = [np.frombuffer(x[2], np.uint8) for x in own if x[0] == "adpcm"]
                ends = np.cumsum([len(c) // UNIT for c in coded])
                decoded = iter(np.split(decode_adpcm(np.concatenate(coded).reshape(-1, UNIT)), ends[:-1]) if coded else ())
                rows_out = []
                for x in found:
                    if x is None:
                        rows_out.append((None,) * 6)
                        continue
                    pcm = next(decoded).ravel() if x[0] == "adpcm" else TABLES[x[0]][np.frombuffer(x[2], np.uint8)]
                    pcm = resample(pcm, x[1], to)
                    size = np.abs(pcm.astype(np.int32))
                    signs = pcm < 0
                    rows_out.append((x[2], pcm.astype("<i2").tobytes(), len(pcm), int(size.max(initial=0)), int(size.sum(dtype=np.int64)), int(np.count_nonzero(signs[1:] != signs[:-1]))))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows_out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *names])

    return rows.drop(*names).mapInArrow(run, _schema(rows.drop(*names), None, "payload binary, pcm binary, n_samples long, peak long, sum_abs long, zero_crossings long"))


def _schema(rows: DataFrame, without: str | None, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != without), more])


def _parts(batch: pa.RecordBatch, at: int, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose values in column at come to most_bytes, or one row."""
    column, start, held = batch.column(at), 0, 0
    for k in range(batch.num_rows):
        size = len(column[k].as_buffer()) if column[k].is_valid else 0
        if k > start and held + size > most_bytes:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = whole_text().cast("binary")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.octet_length(payload).cast("long").alias("n_bytes"), payload.alias("payload"))
    found = decode_media(store_media(docs))
    return found.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", "codec", "n_samples", "peak", "sum_abs", "zero_crossings", F.crc32("pcm")).alias("feature"),
    )


QUERIES = {"op5_media": op5_media}
ORACLES: dict[str, str] = {}
