import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ruleloom.llm import bpe
from ruleloom.llm.registry import RUN
import ruleloom.llm.queries  # noqa: F401


@pytest.fixture(scope="module")
def tok():
    return bpe.Tokenizer(bpe.default_path())


@pytest.fixture(scope="module")
def library(tok):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tok.ranks, special_tokens={})


def test_random_texts_match_the_library(tok, library):
    random.seed(5)
    signs = " \n\t'''srtvlemdxXé1٣!. 　日 \r🙂"
    texts = ["".join(random.choice(signs) for _ in range(random.randrange(60))) for _ in range(3000)]
    for text, ids in zip(texts, tok.encode(texts)[0]):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)
        assert tok.decode(ids) == text.encode()


def test_every_code_point(tok, library):
    text = "".join(f"a{chr(c)} 1" for c in range(0x30000) if not 0xD800 <= c < 0xE000)
    assert np.frombuffer(tok.encode([text])[0][0], "<u4").tolist() == library.encode_ordinary(text)


def test_offsets_give_the_pieces(tok):
    text = "It's  here, we'll'd"
    at = tok.pieces([text])[0].tolist()
    assert [text[a:b] for a, b in zip(at, at[1:])] == ["It", "'s", " ", " here", ",", " we", "'ll", "'d"]
    assert [o.tolist() for o in tok.pieces(["", " ", ""])] == [[0], [0, 1], [0]]


def test_cache_generations(tok, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 500)
    texts = ["alpha betagam deltaxyz " * 3, "zorgq alpha blixm", "alpha betagam", "qqqqx"]
    own = bpe.Tokenizer(bpe.default_path())
    assert [own.encode([t])[0] for t in texts] == [tok.encode([t])[0] for t in texts]


def test_scan_matches_single_steps():
    random.seed(2)
    kinds = np.array([random.randrange(12) for _ in range(3001)], np.uint8)
    state, want = bpe.FRESH, []
    for k in kinds.tolist():
        state = bpe._step(state, k)
        want.append(state)
    assert bpe.states(kinds).tolist() == want


def test_operator_and_query(spark, docs, folder, library):
    coded = {(r.doc_id, bytes(r.ids)) for r in bpe.encode(docs).collect()}
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert coded == {(i, np.array(library.encode_ordinary(t), "<u4").tobytes()) for i, t in rows}
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in back) == sorted((i or 0, t.encode()) for i, t in rows)
    got = RUN["op7_byte_bpe"](spark, folder(documents=docs)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert RUN["op7_byte_bpe"](spark, folder(documents=docs.limit(0))).count() == 0
