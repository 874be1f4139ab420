import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from lakequarry.llm import byte_bpe, packing

from .fixtures import documents, table


def plain():
    t = Tokenizer.from_file(byte_bpe.vocabulary_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_match_the_library():
    encode, bpe = plain(), byte_bpe.ByteBpe()
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b", "a\n  b", "a \t\n b ", "don't 's 'll x'y", "x \n", "x\n ", "\n\n", "été größe ñ", "数 据 🙂 a", "1,000 $3.5%% ###", "a  b", "a\x1c b", "tab\t x", "² ½ ªº a", "_a __ b_c"]
    texts += [" ".join(f"w{i}.\nNext" for i in range(300)), "<|endoftext|> x", "a <|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endoftext |> <|endoftex"]
    for t in texts:
        assert np.frombuffer(bpe.ids_of(t), "<u4").tolist() == encode(t), repr(t)


def test_each_id_in_exactly_one_piece(spark, tmp_path):
    d = table(spark, tmp_path, "documents", documents(spark))
    encode = plain()
    want = sorted(((r.doc_id is None, r.doc_id, tuple(encode(r.text or "") + [1])) for r in spark.read.parquet(f"{d}/documents.parquet").collect()))
    pieces = packing.pack(spark.read.parquet(f"{d}/documents.parquet")).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert 1 <= p.length <= 2048 and p.length == len(p.ids) // 4
        sequences[p.sequence_id].append(p)
        docs[p.doc_id].append(p)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    short = sum(sum(p.length for p in own) < 2048 for own in sequences.values())
    assert short <= 3  # one a task
    by_id = defaultdict(list)
    for _, doc_id, ids in want:
        by_id[doc_id].append(ids)
    for doc_id, texts in by_id.items():
        assert sum(p.length for p in docs[doc_id]) == sum(map(len, texts))
        if len(texts) == 1:
            ordered = sorted(docs[doc_id], key=lambda p: p.start)
            assert tuple(np.frombuffer(b"".join(p.ids for p in ordered), "<u4").tolist()) == texts[0]
            assert all(p.doc_tokens == len(texts[0]) for p in ordered)
    row = packing.op2_packing(spark, d).where("doc_id = 103 and start = 0").first()
    assert row.ids_crc32 == zlib.crc32(np.array(encode(spark.read.parquet(f"{d}/documents.parquet").where("doc_id = 103").first().text)[: row.length], "<u4").tobytes())


def test_placement_minimises_the_sum_of_squares():
    packer = packing.SquaresPacker(16)
    rng = np.random.default_rng(1)
    for size in rng.integers(1, 16, 300).tolist():
        before = packer.counts.copy()
        best = []
        for level in [0, *np.flatnonzero(before).tolist()]:
            if level + size <= 16:
                after = before.copy()
                if level:
                    after[level] -= 1
                if level + size < 16:
                    after[level + size] += 1
                best.append(int((after**2).sum()))
        packer.add((0, 0, size, bytes(4 * size)))
        assert int((packer.counts**2).sum()) == min(best)


def test_empty_table(spark, tmp_path):
    assert packing.op2_packing(spark, table(spark, tmp_path, "documents", documents(spark).limit(0))).count() == 0


def test_open_windows_are_bounded_and_nothing_is_lost():
    packer = packing.SquaresPacker(16, most_open=5)
    rows = [(k, np.arange(k * 10, k * 10 + 9, dtype="<u4").tobytes()) for k in range(100)]  # no two fit together
    out, held = [], 0
    for window in packing.pack_rows(iter(rows), packer):
        held = max(held, packer.n_open)
        out.append(window)
    assert held <= 5 and sum(sum(len(p[3]) // 4 for p in w) < 16 for w in out) <= 1
    ids = sorted(i for w in out for p in w for i in np.frombuffer(p[3], "<u4").tolist())
    assert ids == sorted(i for _, x in rows for i in np.frombuffer(x, "<u4").tolist())
    assert all(p[3] == rows[p[0]][1][4 * p[1] : 4 * p[1] + len(p[3])] and p[2] == 9 for w in out for p in w)
