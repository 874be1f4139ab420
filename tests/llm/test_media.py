import hashlib
import zlib

import numpy as np

from lakequarry.llm import media as M

from .fixtures import documents, table


def plain_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(M.STEPS[index])
            change = step >> 3
            change += step if nibble & 4 else 0
            change += step >> 1 if nibble & 2 else 0
            change += step >> 2 if nibble & 1 else 0
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[nibble & 7]))
            out.append(value)
    return out


def test_adpcm_across_blocks_matches_one_by_one():
    blocks = np.random.default_rng(1).integers(0, 256, (50, 64), dtype=np.uint8)
    assert M.decode_adpcm(blocks).tolist() == [plain_adpcm(b.tobytes()) for b in blocks]


def test_companding_tables():
    u, a = M.TABLES["ulaw"], M.TABLES["alaw"]
    assert (u[0], u[127], u[128], u[255]) == (-32124, 0, 32124, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert len(set(a.tolist())) == 256 and len(set(u.tolist())) == 255


def test_resampling():
    x = np.array([0, 100, -30000, 30000, 5], np.int16)
    doubled = M.resample(x, 8000, 16000)
    assert doubled[::2].tolist() == x.tolist() and len(doubled) == 10
    p = [int(v) for v in x]
    at = lambda i: p[max(0, min(4, i))]
    want = [max(-32768, min(32767, (at(i - 2) - 5 * at(i - 1) + 20 * at(i) + 20 * at(i + 1) - 5 * at(i + 2) + at(i + 3) + 16) >> 5)) for i in range(5)]
    assert doubled[1::2].tolist() == want
    assert M.resample(np.array([0, 10, 20], np.int16), 2, 6).tolist() == [0, 3, 6, 10, 13, 16, 20, 20, 20]


def test_wav_round_trip_and_strange_files():
    for codec in M.CODECS:
        assert M.read_wav(M.wav(codec, bytes(range(64)))) == (codec, 8000, bytes(range(64)))
    for bad in (None, b"", b"RIFF", M.wav("ulaw", b"abcd")[:-1], M.wav("adpcm", b"abc"), b"RIFFxxxxWAVE" + b"x" * 40):
        assert M.read_wav(bad) is None


def test_query(spark, tmp_path):
    d = table(spark, tmp_path, "documents", documents(spark))
    want = []
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        raw = (r.text or "").encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        codec = M.CODECS[zlib.crc32(data) % 3]
        pcm = [v for k in range(0, len(data), 64) for v in plain_adpcm(data[k : k + 64])] if codec == "adpcm" else [int(M.TABLES[codec][x]) for x in data]
        pcm = M.resample(np.array(pcm, np.int16), 8000, 16000)
        file = M.wav(codec, data)
        size = np.abs(pcm.astype(int))
        signs = pcm < 0
        feature = f"{codec};{len(pcm)};{size.max()};{size.sum()};{(signs[1:] != signs[:-1]).sum()};{zlib.crc32(pcm.tobytes())}"
        want.append((r.doc_id is None, r.doc_id, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature))
    assert sorted((r.doc_id is None, *r) for r in M.op5_media(spark, d).collect()) == sorted(want)


def test_broken_media_and_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, bytearray(b"no file")), (2, None)], "id int, media binary")
    assert [(r.payload, r.pcm, r.peak) for r in M.decode_media(rows).collect()] == [(None, None, None)] * 2
    assert M.op5_media(spark, table(spark, tmp_path, "documents", documents(spark).limit(0))).count() == 0


def test_clashing_columns_and_a_long_payload(spark):
    long = bytes(range(256)) * 4000
    rows = spark.createDataFrame([(1, bytearray(long), "mine", bytearray(b"x"), "p", "kept")], "id int, payload binary, codec string, media binary, pcm string, other string")
    stored = M.store_media(rows)
    assert sorted(stored.columns) == ["codec", "id", "media", "other", "pcm"]
    r = M.decode_media(stored).first()
    assert (r.id, r.other, bytes(r.payload), r.codec in M.CODECS) == (1, "kept", long, True) and isinstance(r.pcm, (bytes, bytearray)) and r.n_samples > len(long)
