import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from papyrium.llm import bpe  # noqa: E402

from .util import SCHEMA, corpus, frame, got  # noqa: E402


@pytest.fixture(scope="module")
def vocabulary():
    v = bpe.load(public_tokenizers.path(bpe.FILE))
    v.start()
    return v


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(bpe.FILE))


def ids(code):
    return np.frombuffer(code, dtype="<u4").tolist()


def hard():
    r = random.Random(5)
    out = [t for _, t, *_ in corpus(5)]
    out += ["", " ", "\n", "It's they're I'd 've 'll", "<|endoftext|>", "<|endoftext|", "A<|startoftext|>b<|endoftext|>\n<|endoftext|>", "<|ENDOFTEXT|>", "</w> w</w>", "İstanbul ΑΣ Σ. ǅ ß", "é ẛ̣ ﬁ Å", "日本語のテキスト 中文", "🙂🙂👩‍👩‍👧 ½ ²", "a\x00b\x1cc\x85d e f　g", "x" * 3000, "ab" * 1500, "!" * 2000, "1234567890" * 20, "'s'S'RE", "haha" * 300]
    out += ["".join(r.choice("abcdefghinorst' ") for _ in range(r.randrange(300))) for _ in range(400)]
    out += ["".join(chr(r.choice([r.randrange(1, 0x300), r.randrange(0x300, 0xD800), r.randrange(0xE000, 0x110000), 32, 97, 0x301, 10])) for _ in range(r.randrange(120))) for _ in range(400)]
    return out


def test_ids_and_text_of_the_library(vocabulary, library):
    for text in hard():
        want = library.encode(text or "", add_special_tokens=False).ids
        code = vocabulary.encode(text or "")
        assert ids(code) == want, text
        assert vocabulary.decode([code]).to_pylist() == [library.decode(want, skip_special_tokens=False)]


def test_every_code_point_of_the_fast_path(vocabulary, library):
    for c in range(0x300):
        text = f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}"
        assert ids(vocabulary.encode(text)) == library.encode(text, add_special_tokens=False).ids, hex(c)


def merged(vocabulary, symbols):
    """Merging by rank, leftmost first, one merge at a time."""
    own = list(symbols)
    while True:
        ranks = [(vocabulary.pairs.get(a << 20 | b, 1 << 60), i) for i, (a, b) in enumerate(zip(own, own[1:]))]
        if not ranks or min(ranks)[0] == 1 << 60:
            return own
        rank, i = min(ranks)
        own[i : i + 2] = [rank]


def test_tokens_against_plain_merging(vocabulary):
    r = random.Random(2)
    spelled = lambda t: [t] if t < 512 else spelled(vocabulary.left[t]) + spelled(vocabulary.right[t])
    for _ in range(1500):
        symbols = [s % 256 for _ in range(r.randrange(1, 5)) for s in spelled(r.randrange(len(vocabulary.left)))]
        symbols[-1] += 256
        assert vocabulary.word(symbols) == merged(vocabulary, symbols)
    # every token of the tables is what merging makes of its own symbols, or is not in the automaton
    reached = set(vocabulary.found)
    for t in r.sample(range(512, len(vocabulary.left)), 3000):
        assert (merged(vocabulary, spelled(t)) == [t]) == (t in reached)


def test_other_vocabularies():
    """Tokens that merging can't reach are never taken; equal merges raise."""
    letters = {n: b for n, b in bpe.byte_letters().items()}
    base = [*letters, *(n + "</w>" for n in letters)]
    merges = ["a b", "c b", "b c", "ab c", "a bc"]  # abc comes by "ab c" only; "a bc" would repeat it
    def spec(m):
        vocab = {n: i for i, n in enumerate([*base, *(x.replace(" ", "") for x in m)])}
        model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "ignore_merges": False, "vocab": vocab, "merges": m}
        cut = [{"type": "Split", "pattern": {"Regex": r"\S+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
        return {"model": model, "normalizer": {"type": "Sequence", "normalizers": bpe.NORMAL}, "pre_tokenizer": {"pretokenizers": cut}, "added_tokens": [], "decoder": None, "post_processor": None}
    with pytest.raises(ValueError):
        bpe.Vocabulary(spec(merges))
    # "b c" comes before "a b": abc can't be reached by "ab c"
    v = bpe.Vocabulary(spec(["b c", "a b", "ab c"]))
    v.start()
    assert 514 not in set(v.found)
    r = random.Random(3)
    for _ in range(500):
        symbols = [ord(r.choice("abc")) for _ in range(r.randrange(1, 12))]
        symbols[-1] += 256
        assert v.word(symbols) == merged(v, symbols)
    with pytest.raises(ValueError):
        bpe.Vocabulary(spec(merges[:2]) | {"normalizer": None})


def test_time_grows_with_the_length(vocabulary):
    import time

    def seconds(k):
        text = "".join(random.Random(1).choice("abcdefghinorst") for _ in range(k))
        began = time.perf_counter()
        vocabulary.encode(text)
        return time.perf_counter() - began

    seconds(20_000)
    assert seconds(400_000) < 25 * max(seconds(40_000), 0.02)


def test_frames(spark, vocabulary, library):
    rows = corpus(8)[:60]
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "no id", "en", "s", 5), rows[0], (902, "long words " * 500_000, "en", "s", 1)]
    fresh = bpe.load(public_tokenizers.path(bpe.FILE))
    docs = frame(spark, rows).selectExpr("*", "1 AS row", "'in' AS `in`", "2 AS `a.b`", "3 AS IDS", "4 AS N_Tokens").repartition(3)
    coded = bpe.encode(docs, fresh)
    assert sorted(coded.columns) == sorted(["doc_id", "lang", "source", "n_chars", "row", "in", "a.b", "n_tokens", "ids"])
    back = bpe.decode(coded, fresh, out_col="plain").collect()
    assert len(back) == len(rows)
    texts = {(r[0], r[4]): r[1] or "" for r in rows}
    for r in back:
        want = library.encode(texts[r["doc_id"], r["n_chars"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(want) and r["plain"] == library.decode(want, skip_special_tokens=False) and (r["row"], r["in"], r["a.b"]) == (1, "in", 2)
    assert bpe.encode(spark.createDataFrame([], SCHEMA), fresh).count() == 0
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(np.array([0, 60_000, 2**32 - 1, 1], dtype="<u4").tobytes()))], "doc_id long, ids binary")
    assert {i: r["text"] for i, r in got(bpe.decode(odd, fresh)).items()} == {1: "", 2: "", 3: "! \""}


def test_query(spark, tmp_path, library):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(hard()[:200])]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = got(bpe.op13_bpe(spark, str(tmp_path)))
    for i, text, *_ in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(want, skip_special_tokens=False)
        assert found[i] == {"doc_id": i, "n_tokens": len(want), "ids_sha256": hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest()}
