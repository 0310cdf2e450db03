import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from llm.conftest import EDGES, prose

from tallyforge.llm.encoding import ChunkEncoder, TokenizerFile
from tallyforge.llm.packing import pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(texts, rows, ids=None):
    encoder = ChunkEncoder(TokenizerFile.read(PATH))
    whole = {k: encoder.whole(t or "") + (2).to_bytes(4, "little") for k, t in enumerate(texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(whole)
    for k, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(whole[k]) // 4
            assert p.ids_crc32 == zlib.crc32(whole[k][4 * p.start : 4 * (p.start + p.length)])
            at += p.length
        assert at == len(whole[k]) // 4
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == pieces[0].tier <= 4096 and at & (at - 1) == 0


def test_every_id_once_and_no_padding(messy):
    rnd = random.Random(3)
    texts = [*EDGES, *[prose(rnd, rnd.choice((0, 3, 50, 200, 900, 3000))) for _ in range(120)], prose(rnd, 40_000)]
    check(texts, pack(messy(texts), PATH).collect())


def test_steps_are_balanced(messy):
    rnd = random.Random(5)
    rows = pack(messy([prose(rnd, rnd.randint(50, 900)) for _ in range(300)]).coalesce(1), PATH, step_tokens=8192, groups=2).collect()
    tokens, tiers = defaultdict(int), defaultdict(set)
    for r in rows:
        tokens[r.step_group] += r.length
        tiers[r.step_group].add(r.tier)
    assert max(tokens.values()) <= 8192
    assert all(len(t) == 1 for t in tiers.values())
    assert sum(n == 8192 for n in tokens.values()) >= len(tokens) // 2


def test_empty_null_and_repeated(messy):
    assert pack(messy(["x"]).limit(0), PATH).count() == 0
    rows = pack(messy([None, "a", "a"], [None, 4, 4]), PATH).collect()
    assert sorted(str(r.doc_id) for r in rows if r.start == 0) == ["4", "4", "None"]
    with pytest.raises(ValueError):
        pack(messy(["x"]), PATH, tiers=(4096, 1000))
