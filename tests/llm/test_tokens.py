import random

import public_tokenizers
import pytest
from llm.conftest import EDGES, prose

from tallyforge.llm.encoding import ChunkEncoder, TokenizerFile
from tallyforge.llm.token_counts import count_tokens

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = [chr(c) for c in (0xE9, 0xDF, 0x3A3, 0x130, 0x131, 0x17F, 0x212A, 0x301, 0x4E2D, 0xA0, 0x1C, 0x85, 0x3000, 0x1F600, 0xAA, 0xB5, 0xD7, 0xB2, 0x2028)]


@pytest.mark.parametrize("name", FILES)
def test_parts_give_the_ids_of_the_whole(name):
    rnd = random.Random(4)
    letters = [*"abXYZ019'  \n\t\r.,!?-sT<|>_", "<|endoftext|>", " 's", "n't", "'ll", "  ", *ODD]
    plain = [*"abXYZ019'  \n\t\r.,!?-sT_", " 's", "n't", *ODD[:2]]
    encoder = ChunkEncoder(TokenizerFile.read(public_tokenizers.path(name)))
    for k in range(3000):
        text = "".join(rnd.choice(letters if k % 2 else plain) for _ in range(rnd.randint(0, 30)))
        assert encoder.ids(text) == encoder.whole(text), ascii(text)


def test_counts_and_cache(spark, messy, tmp_path):
    texts = [*EDGES, *[prose(random.Random(k % 7), 700 if k % 5 == 0 else 20) for k in range(20)], "<|endoftext|> end", "x" * 200_000]
    path, cache = public_tokenizers.path(FILES[0]), f"file://{tmp_path}/cache"
    encoder = ChunkEncoder(TokenizerFile.read(path))
    wanted = sorted((k, len((t or "").encode()), n := len(encoder.whole(t or "")) // 4, n > 512) for k, t in enumerate(texts))
    docs = messy(texts)
    assert sorted(map(tuple, count_tokens(docs, path, cache).collect())) == wanted
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in texts})
    # Nothing is left to encode, and a further text is the only one that is.
    assert sorted(map(tuple, count_tokens(docs, path, cache).collect())) == wanted
    assert spark.read.parquet(cache).count() == stored.count()
    count_tokens(messy(["something new", "word"]), path, cache)
    assert spark.read.parquet(cache).count() == stored.count() + 1


def test_cached_counts_are_used(spark, messy, tmp_path):
    path, cache = public_tokenizers.path(FILES[0]), f"file://{tmp_path}/cache"
    file = TokenizerFile.read(path)
    spark.sql("SELECT unhex(sha2('word', 256)) AS digest, 77L AS n_tokens").write.parquet(f"{cache}/version={file.version}")
    assert [r.n_tokens for r in count_tokens(messy(["word"]), path, cache).collect()] == [77]


def test_other_libraries_and_empty_table(spark, messy, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = count_tokens(messy(["a few words", None]), path, f"file://{tmp_path}/a").collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(0, len(library.encode("a few words"))), (1, 0)]
    assert count_tokens(messy(["x"]).limit(0), path, f"file://{tmp_path}/b").count() == 0


def test_repeated_and_null_ids_stay(messy, tmp_path):
    got = count_tokens(messy(["a", "a", "b", None], [5, 5, None, None]), public_tokenizers.path(FILES[0]), f"file://{tmp_path}/c").collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == [("5", 1), ("5", 1), ("None", 0), ("None", 1)]


def test_stored_counts_are_joined_even_when_there_are_none(spark, messy, tmp_path, monkeypatch):
    """The plan of the misses has the join with the cache, be it empty or filled; a repeated text is one miss."""
    from tallyforge.llm import token_counts

    seen = []
    count = token_counts.count_misses
    monkeypatch.setattr(token_counts, "count_misses", lambda misses, file: seen.append((misses._jdf.queryExecution().optimizedPlan().toString(), misses.count())) or count(misses, file))
    path, cache = public_tokenizers.path(FILES[0]), f"file://{tmp_path}/d"
    for texts in (["a", "b", "a", None], ["b", "c", ""]):
        assert count_tokens(messy(texts), path, cache).count() == len(texts)
    assert [n for _, n in seen] == [3, 1] and all("LeftAnti" in plan for plan, _ in seen)
