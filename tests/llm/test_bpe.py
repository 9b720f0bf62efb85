"""BPE against the library that the vocabulary file is made for."""

import hashlib
import random

import pytest
import tokenizers

from hitloom.llm import bpe, queries, token_counts

PATH = token_counts.public_path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    return bpe.Model(PATH)


def same(model, library, texts):
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = model.encode_all(texts)
    assert [g.tolist() for g in got] == want
    assert [model.decode(g) for g in got] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_every_code_point_alone_and_between_letters(model, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 17 == 0)]
    for form in ("{0}", "a{0}b", " {0}\u0301{0} "):
        texts = [form.format(c) for c in points]
        for i in range(0, len(texts), 20_000):
            same(model, library, texts[i : i + 20_000])


def test_random_texts_special_tokens_and_white_space(model, library):
    rng = random.Random(1)
    letters = "abcdefghij'st  reΣσİ<|>1é日\u0301\n\t\x1c\x85\xa0!?-"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(90))) for _ in range(5000)]
    same(model, library, [*texts, "", " ", "<|endoftext|>x<|startoftext|><|endoftext|>", "<|endoftext|", "ΟΔΟΣ ΣΑΣ", "it's they'LL"])


def test_long_words_go_the_same_way(model, library):
    rng = random.Random(2)
    long = ["".join(rng.choice("abcdeinthr") for _ in range(n)) for n in (bpe.LONG, bpe.LONG + 1, 20_000)]
    same(model, library, [*long, "a" * 5001, "ab" * 4000, "!" * 3001, "日" * 3000, "x " + "na" * 9000 + " y"])
    words = ["".join(rng.choice("abcdeinthr") for _ in range(rng.randrange(1, 200))) for _ in range(200)] + ["a" * k for k in range(1, 40)]
    assert model.rounds(*model.symbols(words)) == [model.by_rank(model.symbols([w])[0]) for w in words]
    assert model.rounds(*model.symbols([])) == []


def test_a_file_with_merges_out_of_order_is_an_error(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        given = json.load(f)
    given["model"]["merges"] = given["model"]["merges"][::-1]
    (tmp_path / "odd.json").write_text(json.dumps(given), encoding="utf-8")
    with pytest.raises(ValueError, match="ranks before"):
        bpe.Model(str(tmp_path / "odd.json"))


def test_query_on_a_whole_table(spark, sf, library):
    documents = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for r in documents:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op12_bpe(spark, sf).collect()} == want


def test_ids_of_any_type_nulls_and_decoding(spark):
    rows = [("a", None), (None, "Some text"), ("b", ""), ("b", "x" * 300_000)]
    out = bpe.encode(spark.createDataFrame(rows, "name string, body string"), PATH, "name", "body")
    assert out.columns == ["name", "ids"]
    back = bpe.decode(out.unionByName(spark.createDataFrame([("n", None)], out.schema)), PATH)
    got = sorted(((r["name"], r.text) for r in back.collect()), key=repr)
    assert [g for g in got if g[0] != "b"] == sorted([("a", ""), (None, "some</w> text</w>"), ("n", None)], key=repr)
    assert {len((t or "").replace("</w>", "").replace(" ", "")) for n, t in got if n == "b"} == {0, 300_000}
