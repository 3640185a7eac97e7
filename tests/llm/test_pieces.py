import hashlib
import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
import public_tokenizers  # noqa: E402

from strandline.llm import pieces  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return pieces.PieceTable.load(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_equals_the_library_on_random_texts(both):
    own, library = both
    rng = random.Random(5)
    parts = list("abeih  \t\n▁0159.,<>x0éß日本😀 ﷺ​\x00") + ["the", "ing", "    ", "<s>", "<0x41>", "�", "aaaa", "====", "tion"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)] + ["", " ", "a" * 5000, " " * 3000, "=-" * 3000]
    ids = own.encode(texts)
    assert ids == library.encode(texts, add_eos=True)
    assert [own.decode(i) for i in ids] == [library.decode(i) for i in ids]


def test_decodes_any_ids_as_the_library(both):
    own, library = both
    rng = random.Random(7)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 0, 1, 2, 259]) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids)


def test_null_empty_repeated_rows_and_clashing_columns(spark, both):
    own, library = both
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "two words", "z"), (3, "two words", "z")], "doc_id long, text string, n_tokens string")
    rows = sorted(pieces.digest_documents(docs, own).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ids = library.encode("two words", add_eos=True)
    three = (3, len(ids), sha(" ".join(map(str, ids))), sha("two words"))
    assert [tuple(r) for r in rows] == [(1, 1, sha("2"), sha("")), (2, 1, sha("2"), sha("")), three, three]
    assert pieces.encode_documents(docs.limit(0), own).count() == 0


def test_long_words_in_little_time():
    """Long words without blanks: random letters, runs of one sign (one merge a round for some), short periods, another script."""
    import random
    import time

    path = public_tokenizers.path("piece_bpe_32k.model")
    table, sp = pieces.PieceTable.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=80_000)), "#" * 50_000, "o" * 50_000, "=" * 200_000, "the" * 20_000, "ab" * 50_000, "".join(map(chr, rng.choices(range(0x4E00, 0x9000), k=30_000)))]
    words += ["".join(rng.choices(letters, k=rng.randrange(1, 400))) for letters in ("ent", "=-#", "oo.", "aeioust") for _ in range(200)]
    began = time.process_time()
    got = table.encode(words)
    assert time.process_time() - began < 30
    assert got == [sp.encode(w) + [sp.eos_id()] for w in words]


def test_columns_of_any_name_beside_the_ids(spark):
    import public_tokenizers

    table = pieces.PieceTable.load(public_tokenizers.path("piece_bpe_32k.model"))
    df = spark.createDataFrame([(1, "a text", 5)], "doc_id long, text string, ids int")
    got = pieces.encode_documents(df, table, extra=("ids", "text", "doc_id"))
    assert got.columns == ["ids", "text", "doc_id", "ids", "decoded"]
    row = got.first()
    assert (row[0], row[1], row[2], row[4]) == (5, "a text", 1, "a text") and row[3] == table.encode(["a text"])[0]
