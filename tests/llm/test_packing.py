import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sonolith.llm import packing
from sonolith.llm.queries import tokenizer_path


def plain(path, text):
    return np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [1], "<u4").tobytes()


@pytest.mark.parametrize("cache", [40, 100_000])
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_agrees_with_the_tokenizer(name, cache, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 300)
    monkeypatch.setattr(packing, "CACHE", cache)
    rnd = random.Random(1)
    path = tokenizer_path(name)
    odd = ["it's <|endoftext|>x <|startoftext|>", "Ünï cödé \x1cabc\x85d é İ Σίσυφος ΟΔΟΣ a\xa0b", "don't  12345 !!?? a'b'll x²³½ ª", "", "Cáfe ÀÖØö ǅ × ÷", "日本 語テキスト 🙂🙂 ok", "\x00 \x7f a​b", "I'M WE'LL o'Reilly 'tis"]
    odd += ["".join(rnd.choice("abcXYZ éÀ'.,!<|>0 9\n\t\xa0ßſK") for _ in range(rnd.randint(1, 900))) for _ in range(60)]
    got = list(packing.Encoder(path, 1)(pa.array([*odd, None])))
    assert got == [plain(path, t) for t in [*odd, ""]]


def test_plan_uses_every_piece_once_and_fits():
    rnd = random.Random(2)
    for lengths in ([rnd.randint(1, 64) for _ in range(3000)], [64] * 9, [33] * 50, [1] * 200, [40, 24, 10, 14, 40, 50, 14, 30, 20, 8, 6], []):
        c = Counter(lengths)
        bins = packing.plan(dict(c), 64)
        got = Counter()
        for kinds, n in bins:
            assert sum(kinds) <= 64 and n > 0
            for x in kinds:
                got[x] += n
        assert got == c
        if lengths and max(lengths) <= 64 and len(lengths) > 1000:
            assert sum(n for _, n in bins) <= -(-sum(lengths) // 64) * 1.01


def test_packed_documents_round_trip(spark):
    rnd = random.Random(3)
    words = ["alpha", "Beta", "naïve", "12", "!!", "ωmega"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 90)))) for i in range(80)] + [(80, None), (80, None), (None, "x y"), (81, "a " * 700)] + [(100 + i, "same text here") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS salt", "3 AS rank").repartition(3)
    path = tokenizer_path()
    got = packing.pack_documents(df, path, 64).collect()
    want = Counter()
    for doc_id, text in rows:
        raw = plain(path, text or "")
        want.update((doc_id, p, at // 4, len(raw[at : at + 256]) // 4, zlib.crc32(raw[at : at + 256])) for p, at in enumerate(range(0, len(raw), 256)))
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= -(-sum(r.length for r in got) // 64) + 3
    with_ids = packing.pack_documents(df, path, 64, with_ids=True).where("doc_id = 81").orderBy("piece").collect()
    assert sum((list(r.ids) for r in with_ids), []) == np.frombuffer(plain(path, "a " * 700), "<u4").tolist()
    assert packing.pack_documents(df.where("false"), path).count() == 0
