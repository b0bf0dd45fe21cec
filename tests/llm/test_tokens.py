"""Token files, counts and packing against the libraries."""

import random
import zlib

import numpy as np
import pytest

from rasterloom.llm import packing, token_counts, token_files, tokens

public = pytest.importorskip("public_tokenizers")
SIGNS = "ab  \n\t'é▁<|>s.,\x1c日🙂\x00A1ſİΣ\u0301"


def fuzz(n=3000):
    rng = random.Random(3)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["a<|endoftext|> b <|endoftext|>", "<s> </s> <unk> <0x41>", "", " ", "x" * 3000, "▁" * 700, "it's we'll 's"]


@pytest.mark.parametrize("portion", [10, 4000, 6 << 20])
@pytest.mark.parametrize(("name", "keeps_space"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_encoder_matches_the_library(name, keeps_space, portion, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "CACHE", 500)
    monkeypatch.setattr(tokens, "PORTION", portion)
    own, library = tokens.WordEncoder(public.path(name), keeps_space), Tokenizer.from_file(public.path(name))
    rng = random.Random(5)
    latin = "ab   \n\t''''sstmdrevel.,\x1cA\u00e91\u00b2\u00bd\u00aa\u00ad\r\x0b\xa0"
    texts = fuzz() + ["".join(rng.choice(latin) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    got = [x.tolist() for x in own.encode_all([t or None for t in texts])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_match_the_library(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(token_counts, "LONG", 12)
    counter = token_counts.Counter(public.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    texts = fuzz()
    assert counter.count(texts) == [len(x) for x in library.encode(texts, num_threads=1)]


def test_count_rows(docs, no_docs):
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(tuple(r) for r in token_counts.token_counts(docs, path, 100).collect())
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert got == sorted((i, len(t.encode()), len(library.encode(t)), len(library.encode(t)) > 100) for i, t in texts)
    assert token_counts.token_counts(no_docs, path).count() == 0


@pytest.mark.parametrize("width", [1, 3, 8, 15, 16, 17, 31])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1001])
def test_packed_bits(width, n):
    ids = np.random.default_rng(n).integers(0, 1 << width, n, dtype=np.uint64)
    packed = token_files.pack(ids, width)
    assert len(packed) == -(-n * width // 8)
    assert (token_files.unpack(packed, n, width) == ids).all()


def test_random_access():
    rng = np.random.default_rng(0)
    ids = [rng.integers(0, 50257, n).astype(np.uint32) for n in (1, 5000, 0, 9000, 3)]
    f = token_files.TokenFile(token_files.file_bytes([4, None, 6, 7, 8], ids, token_files.width_of(50257)))
    assert f.doc_ids == [4, None, 6, 7, 8] and f.width == 16
    assert all((f.document(i) == x).all() for i, x in enumerate(ids))
    assert (f.ids(4090, 4100) == np.concatenate(ids)[4090:4100]).all()
    with pytest.raises(ValueError, match="packed token ids"):
        token_files.TokenFile(b"x" * 40)


def test_token_files_round_trip(spark, docs, no_docs, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "FILE_IDS", 700)
    path = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    files = token_files.write_tokens(docs, path, f"file://{tmp_path}/t", 0, 50257)
    got = [tuple(r) for r in token_files.read_digests(spark, f"file://{tmp_path}/t", files).orderBy("start").collect()]
    expect, start = [], 0
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        expect.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expect
    none = token_files.write_tokens(no_docs, path, f"file://{tmp_path}/none", 0, 50257)
    assert token_files.read_digests(spark, f"file://{tmp_path}/none", none).count() == 0


def test_packing(docs, no_docs):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.packed(docs, path, 64).collect()
    cut = []
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        cut += [(r.doc_id, k, 64 * k, len(ids[64 * k : 64 * k + 64]), zlib.crc32(ids[64 * k : 64 * k + 64].tobytes())) for k in range(-(-len(ids) // 64))]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(cut)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= -(-sum(r.length for r in rows) // 64) + 2
    assert packing.packed(no_docs, path).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_exactly_the_pieces(seed):
    rng = np.random.default_rng(seed)
    top = [4096, 4096, 600, 3000, 4096, 2100][seed]
    lengths = rng.integers(1 if seed % 2 else top // 2, top + 1, 3000)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    runs = packing.plan(histogram)
    held = {}
    for r in runs:
        assert sum(x * n for x, n in r.slots) <= 4096
        for x, n in r.slots:
            held[x] = held.get(x, 0) + n * r.n
    assert held == histogram
    # No more than first fit takes on lengths in descending order.
    rooms = []
    for x in sorted(lengths.tolist(), reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= x), None)
        if at is None:
            rooms.append(4096 - x)
        else:
            rooms[at] -= x
    assert packing.sequences(runs) <= len(rooms) * 1.01 + 1
