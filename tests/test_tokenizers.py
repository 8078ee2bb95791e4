import collections
import json
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusops.contracts import DatasetError
from corpusops.functions.text import SPECIAL_TOKENS, normalize_encoding, normalize_training
from corpusops.operators import bpe, decoding, tokenizer, unigram, vocab
from corpusops.operators.chars import decode_bytes
from corpusops.operators.decoding import decode
from corpusops.operators.tokenizer import TokenizerConfig, TokenizerModel, dump, encode, encode_words
from corpusops.plans.run_tables import RunLog, read_table
from corpusops.plans.tokenizer_job import encode_sequences, inspect_tokenizer, learn, load_tokenizer, read_registry, train_tokenizer
from corpusops.session import WrittenTable, bounded_batches
from corpusops.sources.readers import read_sequences

TEXTS = ["hello world", "tokenizer"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, payload string")


def coded(model, texts):
    return [r["input_ids"] for r in encode(texts, model).orderBy("n").collect()]


def test_bpe_vocabulary_and_unknowns(spark):
    model = learn(frame(spark, TEXTS), TokenizerConfig("bpe", 64))
    merged = "el en er hel iz ken ld lo or oken token wor hello izer tokenizer world".split()
    assert model.tokens == [*SPECIAL_TOKENS, *"dehiklnortwz", *merged]
    assert coded(model, frame(spark, ["hello zebra"])) == [[29, 16, 6, 3, 13, 3]]


def test_char_unknown_bytes_fuse(spark):
    model = learn(frame(spark, TEXTS), TokenizerConfig("char", 64))
    ids = coded(model, frame(spark, ["hello é zebra"]))[0]
    assert ids.count(3) == 3  # the two bytes of é as one; b and a one each
    assert model.special_ids() == {t: i for i, t in enumerate(SPECIAL_TOKENS)}


def test_char_round_trip(spark):
    texts = frame(spark, ["naïve café — ¿qué? 'll 12", "日本語 text", ""])
    model = learn(texts, TokenizerConfig("char", 300, "none", False))
    back = encode(texts, model).orderBy("n").select(decode_bytes(F.col("input_ids"), model.byte_ids())).collect()
    assert [r[0] for r in back] == ["naïve café — ¿qué? 'll 12", "日本語 text", ""]


LIBRARY_TEXTS = [
    "The theatre there, then the other; the other then... aaaa aaa aa banana bananas",
    "Ça été très étrange: «l'été» à l'hôtel — n'est-ce pas? été",
    "It's John's; they'll won't I'm we've 123,456.78 x_y __init__ 10€ \U0001F600\U0001F600 ok",
    "mississippi missing miss mississippi abcabcabc abcabc cabcab",
    "\ttabs\n\nand  spaces   here there   ",
] * 2


@pytest.mark.parametrize("algo, size", [("bpe", 70), ("bpe", 160), ("unigram", 120), ("char", 40), ("char", 300)])
@pytest.mark.parametrize("policy", ["keep", "strip", "space"])
def test_encoding_equals_library(spark, algo, size, policy):
    library = pytest.importorskip("tokenizers")
    texts = frame(spark, LIBRARY_TEXTS)
    model = learn(texts.filter("n <> 1"), TokenizerConfig(algo, size, "nfc", True, policy), seed_size=500)
    reference = library.Tokenizer.from_str(dump(model))
    reference.no_padding()
    expected = [reference.encode(t, add_special_tokens=False).ids for t in LIBRARY_TEXTS]
    assert coded(model, texts) == expected
    again = TokenizerModel.from_json(json.loads(reference.to_str()))
    assert coded(again, texts) == expected


def test_bpe_learning_equals_library(spark):
    """Rounds of many merges give the merges of one at a time, ties included."""
    library = pytest.importorskip("tokenizers")
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    texts = spark.read.parquet(path).select(F.col("doc_id").alias("n"), F.col("text").alias("payload"))
    model = learn(texts, TokenizerConfig("bpe", 2_000, "none", False))
    reference = library.Tokenizer(library.models.BPE(unk_token="<unk>"))
    reference.pre_tokenizer = library.pre_tokenizers.Whitespace()
    trainer = library.trainers.BpeTrainer(
        vocab_size=2_000, min_frequency=1, special_tokens=list(SPECIAL_TOKENS), show_progress=False
    )
    reference.train_from_iterator([r["payload"] for r in texts.collect()], trainer)
    assert model.ids == reference.get_vocab()
    assert [list(m) for m in model.merges] == [list(m) for m in json.loads(reference.to_str())["model"]["merges"]]


@pytest.mark.parametrize(
    "counts, size",
    [({"aaa": 10, "cd": 9}, 12), ({"aaa": 10, "cd": 9}, 10), ({"----": 10, "no": 9, "of": 8}, 13), ({"aaaa": 3, "aa": 5, "ab": 4}, 12)],
)
def test_bpe_order_after_a_pair_of_equal_symbols(spark, counts, size):
    library = pytest.importorskip("tokenizers")
    reference = library.Tokenizer(library.models.BPE(unk_token="<unk>"))
    reference.pre_tokenizer = library.pre_tokenizers.WhitespaceSplit()
    trainer = library.trainers.BpeTrainer(vocab_size=size, min_frequency=1, special_tokens=list(SPECIAL_TOKENS), show_progress=False)
    reference.train_from_iterator([w for w, n in counts.items() for _ in range(n)], trainer)
    found = bpe.learn_bpe(spark.createDataFrame(list(counts.items()), "word string, n long"), size)
    assert {t: i for i, t in enumerate(found.tokens)} == reference.get_vocab()
    assert [list(m) for m in found.merges] == [list(m) for m in json.loads(reference.to_str())["model"]["merges"]]


@pytest.mark.parametrize("algo", ["char", "bpe", "unigram"])
def test_special_tokens_in_text_and_greek_equal_library(spark, algo):
    library = pytest.importorskip("tokenizers")
    texts = [
        "a <unk> b <sep> hello", "<pad>", "x<bos>y<eos>", "<UNK> < unk >", "<<unk>>", "ΟΔΟΣ ΣΑΣ", "  hello <sep>  world <", "e\u0301<unk>e\u0301", None, "",
    ]
    learnt = frame(spark, ["a b hello world x y οδοσ σας < > unk é"] * 3)
    model = learn(learnt, TokenizerConfig(algo, 300, "nfc", True), seed_size=200)
    reference = library.Tokenizer.from_str(dump(model))
    reference.no_padding()
    expected = [reference.encode(t, add_special_tokens=False).ids if t is not None else [] for t in texts]
    assert coded(model, frame(spark, texts)) == expected


def import_case(**model):
    layout = {"type": "BPE", "dropout": None, "unk_token": "[UNK]", "fuse_unk": True, "vocab": {"a": 0, "b": 10, "ab": 20, "[UNK]": 30}, "merges": [["a", "b"]]}
    return {
        "version": "1.0",
        "added_tokens": [{"id": 30, "content": "[UNK]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}],
        "normalizer": None,
        "pre_tokenizer": {"type": "Whitespace"},
        "model": {**layout, **model},
    }


@pytest.mark.parametrize("fuse", [True, False])
def test_import_keeps_ids_and_unknown_token(spark, fuse):
    library = pytest.importorskip("tokenizers")
    document = import_case(fuse_unk=fuse)
    texts = ["xy a ab", "b[UNK]a zz", "azzb"]
    reference = library.Tokenizer.from_str(json.dumps(document))
    model = TokenizerModel.from_json(document)
    assert coded(model, frame(spark, texts)) == [reference.encode(t, add_special_tokens=False).ids for t in texts]
    assert model.ids["ab"] == 20 and set(SPECIAL_TOKENS) <= set(model.ids)
    # A gap between added tokens keeps their ids as well.
    document["added_tokens"].append({**document["added_tokens"][0], "id": 40, "content": "<far>"})
    assert TokenizerModel.from_json(document).ids["<far>"] == 40


@pytest.mark.parametrize(
    "change",
    [
        {"model": {"byte_fallback": True}},
        {"model": {"ignore_merges": True}},
        {"model": {"continuing_subword_prefix": "##"}},
        {"model": {"dropout": 0.1}},
        {"model": {"type": "WordPiece"}},
        {"normalizer": {"type": "NFKC"}},
        {"normalizer": {"type": "Replace", "pattern": {"String": "a"}, "content": "b"}},
        {"pre_tokenizer": {"type": "Metaspace"}},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}},
        {"added_tokens": [{"id": 30, "content": "[UNK]", "lstrip": True}]},
        {"added_tokens": [{"id": 20, "content": "<x>"}]},
    ],
)
def test_import_refuses_what_it_cannot_encode(change):
    document = import_case(**change.get("model", {})) | {k: v for k, v in change.items() if k != "model"}
    with pytest.raises(DatasetError):
        TokenizerModel.from_json(document)


ODD_TEXTS = [
    "Hello, World! naïve Éclair don't un\u00adseen zero\u200bwidth", "x\u0000y\ufffdz \x85 tab\tnl\n", "中文 mixed中x \uf900", "ΟΔΟΣ Σ İ Ǆ", "a" * 120 + " aa",
    "[UNK] hello [CLS]world[SEP]", "[CLS]", "", "   ", None, "e\u0301 \U0001F600\U0001F600 ok ok", "#hash ##x ___ `~ $5.00", "▁a b", "  a  b c ", "a[CLS]a [SEP] a",
]


def equals_library(spark, document):
    """Ids and decoded texts against the common library; returns the model."""
    library = pytest.importorskip("tokenizers")
    reference = library.Tokenizer.from_str(json.dumps(document))
    model = TokenizerModel.from_json(document)
    expected = [reference.encode(t, add_special_tokens=False).ids if t is not None else [] for t in ODD_TEXTS]
    assert coded(model, frame(spark, ODD_TEXTS)) == expected
    # What is written out again encodes alike, here and there.
    assert coded(TokenizerModel.from_json(model.to_json()), frame(spark, ODD_TEXTS)) == expected
    again = library.Tokenizer.from_str(dump(model))
    again.no_padding()
    assert [again.encode(t, add_special_tokens=False).ids if t is not None else [] for t in ODD_TEXTS] == expected
    for skip in (True, False):
        rows = encode(frame(spark, ODD_TEXTS), model)
        back = [r["text"] for r in decode(rows, model, skip_special=skip).orderBy("n").collect()]
        assert back == [reference.decode(ids, skip_special_tokens=skip) for ids in expected]
    return model


def marks(*contents):
    flags = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    return [{"id": i, "content": t, **flags} for i, t in enumerate(contents)]


def word_file(kind, **change):
    tokens = ["[UNK]", "[CLS]", "[SEP]", "hello", "world", "naive", "a", "##a", "##aa", "don", "'", "t", "un", "##seen", "ok", ",", "!", "x", "##y", "##z", "中", "e", "é"]
    model = {"type": kind, "vocab": {t: i for i, t in enumerate(tokens)}, "unk_token": "[UNK]"}
    if kind == "WordPiece":
        model |= {"continuing_subword_prefix": "##", "max_input_chars_per_word": 100}
    base = {"version": "1.0", "added_tokens": marks("[UNK]", "[CLS]", "[SEP]"), "normalizer": None, "pre_tokenizer": {"type": "BertPreTokenizer"}}
    return base | {"post_processor": None, "decoder": None, "model": model} | change


def cleaner(**change):
    return {"type": "BertNormalizer", "clean_text": True, "handle_chinese_chars": True, "strip_accents": None, "lowercase": True} | change


@pytest.mark.parametrize(
    "kind, change",
    [
        ("WordPiece", {"normalizer": cleaner(), "decoder": {"type": "WordPiece", "prefix": "##", "cleanup": True}}),
        ("WordPiece", {"normalizer": cleaner(lowercase=False, strip_accents=True, handle_chinese_chars=False)}),
        ("WordPiece", {"normalizer": cleaner(strip_accents=False, clean_text=False), "decoder": {"type": "WordPiece", "prefix": "##", "cleanup": False}}),
        ("WordPiece", {"pre_tokenizer": {"type": "Whitespace"}}),
        ("WordLevel", {"pre_tokenizer": {"type": "WhitespaceSplit"}}),
        ("WordLevel", {"normalizer": cleaner()}),
    ],
)
def test_word_files_equal_library(spark, kind, change):
    model = equals_library(spark, word_file(kind, **change))
    assert model.kind == kind and model.config.algo == kind.lower()


BYTES_BACK = [{"type": "Replace", "pattern": {"String": "▁"}, "content": " "}, {"type": "ByteFallback"}, {"type": "Fuse"}]


@pytest.mark.parametrize("scheme, split", [("always", True), ("first", True), ("never", True), ("always", False), ("first", False)])
@pytest.mark.parametrize("fallback", [True, False])
def test_marked_unigram_files_equal_library(spark, scheme, split, fallback):
    pieces = {"[UNK]": 0.0, "[CLS]": 0.0, "[SEP]": 0.0, "▁": -2.0, "▁a": -1.5, "a": -2.5, "aa": -2.7, "▁hello": -4.0, "ok▁ok": -3.0, "ok": -5.0, "o": -6.0, "k": -6.5, "e": -4.4}
    pieces |= {f"<0x{b:02X}>": -20.0 for b in range(256) if fallback or b < 10}
    strip = {"type": "Strip", "content": " ", "start": 1, "stop": 0}
    equals_library(spark, {
        "version": "1.0", "added_tokens": marks("[UNK]", "[CLS]", "[SEP]"), "normalizer": None, "post_processor": None,
        "pre_tokenizer": {"type": "Metaspace", "replacement": "▁", "prepend_scheme": scheme, "split": split},
        "decoder": {"type": "Sequence", "decoders": [*BYTES_BACK, strip]} if split else {"type": "Metaspace", "replacement": "▁", "prepend_scheme": scheme, "split": split},
        "model": {"type": "Unigram", "unk_id": 0, "byte_fallback": fallback, "vocab": list(pieces.items())},
    })


@pytest.mark.parametrize("algo, size", [("bpe", 120), ("unigram", 120), ("char", 40), ("char", 300)])
def test_decoding_of_learnt_vocabularies_equals_library(spark, algo, size):
    library = pytest.importorskip("tokenizers")
    model = learn(frame(spark, LIBRARY_TEXTS), TokenizerConfig(algo, size), seed_size=300)
    reference = library.Tokenizer.from_str(dump(model))
    rows = encode(frame(spark, LIBRARY_TEXTS + ODD_TEXTS), model).orderBy("n")
    got = [(r["input_ids"], r["text"]) for r in decode(rows, model).orderBy("n").collect()]
    assert [t for _, t in got] == [reference.decode(ids) for ids, _ in got]


def test_decoding_of_odd_ids(spark):
    model = TokenizerModel.from_json(word_file("WordLevel"))
    rows = spark.createDataFrame([(1, None), (2, []), (3, [3, None, -1, 999, 4])], "n long, input_ids array<int>")
    assert [r["text"] for r in decode(rows, model).orderBy("n").collect()] == [None, "", "hello world"]
    assert decode(rows.limit(0), model).count() == 0
    with pytest.raises(DatasetError):
        decode(rows, TokenizerModel.from_json(word_file("WordLevel", decoder={"type": "CTC"})))


def test_bytes_are_counted_and_coded_a_batch_at_once(spark):
    """Byte vocabularies are learnt without pieces and looked up in bulk, as the segmenter does word by word."""
    texts = ["abc ABC <unk>é<pad>", "", None, "ééé ñ<sep><sep>zz", "  a\t日本 ﬁ İx", "<eos>"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, payload string")
    counts = vocab.byte_counts(rows, F.col("payload"))
    assert "'ll" not in counts._jdf.queryExecution().optimizedPlan().toString()
    raw = collections.Counter(b for t in texts if t for b in t.encode())
    assert {int(r["token"], 16): r["n"] for r in counts.collect()} == raw
    for size in (9, 300):
        model = learn(rows, TokenizerConfig("char", size))
        assert tokenizer._is_bytewise(model)
        segment = tokenizer.segmenter(*model.parts())
        lists = [["abc", " ABC", "<unk>", "é"], [], None, ["<pad>", "ñé", "日本", "<sep>", "<sep>", "zz"]]
        words = spark.createDataFrame(list(enumerate(lists)), "n long, words array<string>")
        got = words.select("n", encode_words(F.col("words"), model, spark).alias("ids")).orderBy("n").collect()
        assert [r["ids"] for r in got] == [[i for w in x or [] for i in segment(w)] for x in lists]


def test_texts_are_coded_whole_unless_unknown_bytes_meet(spark):
    """By pieces and whole the ids are the same; unknown bytes of two pieces stay two tokens."""
    texts = ["ab ab", "zé", "éz", "éé", "x1", "1x!", "x 1", "日本1é", "a\U0001F600\U0001F600b", "<PAD>é!", "a<unk>x1", "", None, "b" * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, payload string")
    for size in (6, 7, 9, 12, 300):
        model = learn(rows, TokenizerConfig("char", size))
        normal = model.normal_text(F.col("payload"))
        pieces = rows.select("n", normal.alias("t"), model.word_lists(normal, F.lit(True)).alias("words"))
        whole = tokenizer.encode_whole(F.col("t"), model)
        apart = pieces.select("n", encode_words(F.col("words"), model, spark).alias("ids"), whole.alias("whole"))
        own = {r["n"]: r for r in apart.collect()}
        coded = encode(rows, model)
        assert coded.columns == ["n", "payload", "input_ids"]
        assert {r["n"]: r["input_ids"] for r in coded.collect() if r["n"] != 10} == {n: r["ids"] for n, r in own.items() if n != 10}
        assert all(r["whole"] in (None, r["ids"]) for r in own.values())
        assert size > 6 or own[4]["whole"] is None and len(own[4]["ids"]) == 2
        assert size < 300 or not any(r["whole"] is None for n, r in own.items() if n != 12)


@pytest.mark.parametrize("node", [None, {"type": "WordPiece", "prefix": "##"}, {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "always"}])
def test_texts_of_a_batch_are_joined_at_once(node):
    known = ["a", None, "##é", "▁b", ".", "n't", ""]
    step = decoding.decoder_step(node)
    lists = [[0, 2, 3], None, [], [1, 99, -1, None], [2, 1, 2, 4], [3, 5, 6, 0], [None, 3, 4]]
    kept = [None if x is None else [known[i] for i in x if i is not None and 0 <= i < 7 and known[i] is not None] for x in lists]
    expected = [None if x is None else (" " if node is None else "").join(step(x)) for x in kept]
    for part in (slice(None), slice(3, None), slice(1, 3)):
        batch = pa.array(lists, pa.list_(pa.int32()))[part]
        assert decoding._joined(batch, *decoding._spellings(known, node)).to_pylist() == expected[part]


def random_words():
    rng = random.Random(5)
    letters = "aaabbcdé"
    return {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))): rng.randint(1, 40) for _ in range(400)} | {"a" * 300: 2, "ab" * 50: 3}


def one_merge_at_a_time(counts, size):
    words = {w: list(w) for w in counts}
    ids = {t: i for i, t in enumerate([*SPECIAL_TOKENS, *sorted({c for w in counts for c in w})])}
    merges = []
    while len(ids) < size:
        pairs = collections.Counter()
        for w, n in counts.items():
            for pair in zip(words[w], words[w][1:]):
                pairs[pair] += n
        if not pairs:
            break
        left, right = min(pairs, key=lambda p: (-pairs[p], ids[p[0]], ids[p[1]]))
        ids.setdefault(left + right, len(ids))
        merges.append((left, right))
        for w, parts in words.items():
            out = []
            while parts:
                step = 2 if parts[:2] == [left, right] else 1
                out.append("".join(parts[:step]))
                parts = parts[step:]
            words[w] = out
    return merges


@pytest.mark.parametrize("proposed, guess_words, per_write", [(512, 200_000, 1_024), (40, 8, 30), (7, 1, 5), (5, 0, 1_024)])
def test_wrong_proposals_change_no_merge(spark, monkeypatch, proposed, guess_words, per_write):
    monkeypatch.setattr(bpe, "PROPOSED", proposed)
    monkeypatch.setattr(bpe, "GUESS_WORDS", guess_words)
    monkeypatch.setattr(bpe, "MERGES_PER_WRITE", per_write)
    counts = random_words()
    size = 500 if guess_words > 100 else 60
    found = bpe.learn_bpe(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3), size)
    assert found.merges == one_merge_at_a_time(counts, size)
    assert found.rounds <= (4 if guess_words > 100 else 60)


def test_bpe_min_frequency(spark):
    words = spark.createDataFrame([("abab", 3), ("cd", 2), ("ef", 1)], "word string, n long")
    assert bpe.learn_bpe(words, 100, 2).merges == [("a", "b"), ("ab", "ab"), ("c", "d")]
    assert bpe.learn_bpe(words.limit(0), 100).merges == []


def replaced(parts, pair, new):
    out, i = [], 0
    while i < len(parts):
        step = 2 if tuple(parts[i : i + 2]) == pair else 1
        out.append(new if step == 2 else parts[i])
        i += step
    return out


def test_bpe_words_are_merged_in_arrays():
    """Merges, what they change in the counts of pairs, and taking them back, against word by word."""
    rng = random.Random(5)
    words = [[rng.randrange(3) for _ in range(rng.randrange(12))] for _ in range(200)]
    weights = [rng.randrange(1, 9) for _ in words]

    def counted(words):
        pairs = collections.Counter()
        for w, n in zip(words, weights):
            for a, b in zip(w, w[1:]):
                pairs[a << bpe.PAIR_BITS | b] += n
        return pairs

    found = bpe.Words(np.array(sum(words, []), np.int32), np.array([len(w) for w in words]), np.array(weights))
    found.index()
    states, log = [words], []
    for new, pair in enumerate([(0, 0), (1, 2), (3, 3), (9, 9), (2, 1), (3, 4), (4, 4)], 3):
        words = [replaced(w, pair, new) for w in states[-1]]
        log.append(found.merge(pair[0] << bpe.PAIR_BITS | pair[1], new))
        change = counted(words)
        change.subtract(counted(states[-1]))
        got = {} if log[-1] is None else dict(zip(log[-1].pairs.tolist(), log[-1].n.tolist()))
        assert got == {p: n for p, n in change.items() if n}
        ids, lengths, _ = found.flat()
        assert ids.tolist() == sum(words, []) and lengths.tolist() == [len(w) for w in words]
        back = bpe.symbol_ids(bpe.spelled_words(ids, lengths).slice(3))
        assert back[0].tolist() == sum(words[3:], []) and back[1].tolist() == lengths[3:].tolist()
        states.append(words)
    while log:
        last, words = log.pop(), states.pop()
        if last is not None:
            found.undo(last)
        assert found.flat()[0].tolist() == sum(states[-1], [])
        assert dict(zip(*(x.tolist() for x in found.counts()))) == counted(states[-1])


def test_symbols_sort_like_ids():
    ids = [0, 1, 63, 64, 4095, 4096, 200_000, bpe.MAX_SYMBOLS - 1]
    assert [bpe.symbol_id(bpe.symbol(i)) for i in ids] == ids
    assert sorted(map(bpe.symbol, ids)) == [bpe.symbol(i) for i in ids]


def test_unigram_invariants(spark):
    words = vocab.word_counts(frame(spark, LIBRARY_TEXTS), F.col("payload"))
    for parts in (1, 6):
        learned = unigram.learn_unigram(words.repartition(parts), 90, seed_size=400)
        characters = {c for t in LIBRARY_TEXTS for c in t if not c.isspace()}
        assert characters <= set(learned.pieces)
        assert len(learned.pieces) + 5 <= 90
        assert max(map(len, learned.pieces)) <= 16
        total = sum(2.718281828459045**s for s in learned.scores)
        assert 0.5 < total < 1.05
        if parts == 1:
            once = learned.pieces
    assert learned.pieces == once


def maximal_repeats(counts, max_piece):
    uses = {}
    for word, n in counts.items():
        for i in range(len(word)):
            for j in range(i + 1, min(i + max_piece, len(word)) + 1):
                uses[word[i:j]] = uses.get(word[i:j], 0) + n
    extended = {p[1:] for p, n in uses.items() if n == uses.get(p[1:])} | {p[:-1] for p, n in uses.items() if n == uses.get(p[:-1])}
    return {p: n for p, n in uses.items() if len(p) == 1 or (n >= 2 and p not in extended)}


def seeds_of(spark, counts, max_piece, most, parts=3):
    with WrittenTable(spark, "branches") as table:
        words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(parts)
        return {r["piece"]: r["n"] for r in unigram.seed_pieces(words, max_piece, most, table).collect()}


@pytest.mark.parametrize("max_piece", [2, 4, 16])
def test_seed_pieces_by_brute_force(spark, max_piece):
    counts = {"abcab": 3, "\U0001F600a\U0001F600": 2, "x" * 40: 1, "xxab": 1, "zyx": 5, "caballero": 1, "\uffffa": 2, "a": 7}
    assert seeds_of(spark, counts, max_piece, 1_000) == maximal_repeats(counts, max_piece)
    draw = random.Random(3)
    counts = {"".join(draw.choices("aab\u00e9", k=draw.randint(1, 9))): draw.randint(1, 4) for _ in range(200)}
    assert seeds_of(spark, counts, max_piece, 1_000_000) == maximal_repeats(counts, max_piece)
    assert seeds_of(spark, {}, max_piece, 10) == {}


def test_seeds_are_cut_by_gain_then_piece(spark):
    draw = random.Random(4)
    counts = {"".join(draw.choices("abcde", k=draw.randint(1, 9))): draw.randint(1, 100_000) for _ in range(300)}
    whole = maximal_repeats(counts, 8)
    ranked = sorted((p for p in whole if len(p) > 1), key=lambda p: (-whole[p] * len(p), p))
    for most in (0, 1, 57, 200):
        kept = {p for p in whole if len(p) == 1} | set(ranked[:most])
        assert seeds_of(spark, counts, 8, most) == {p: whole[p] for p in kept}


def plain_unigram(counts, vocab_size, max_piece, seed_size):
    """The same learning on the driver, word by word."""
    words, weights = list(counts), np.array([float(n) for n in counts.values()])
    uses = maximal_repeats(counts, max_piece)
    longer = sorted((p for p in uses if len(p) > 1), key=lambda p: (-uses[p] * len(p), p))[:seed_size]
    scores = {p: uses[p] * len(p) for p in uses if len(p) == 1 or p in longer}
    scores = {p: np.log(w / sum(scores.values())) for p, w in scores.items()}
    room = vocab_size - len(SPECIAL_TOKENS)

    def lattice(texts, **more):
        names = list(scores)
        return names, np.array(list(scores.values())), unigram.Lattice(texts, {p: i for i, p in enumerate(names)}, max_piece, **more)

    while True:
        for _ in range(2):
            names, values, made = lattice(words)
            share = {p: max(u, 0.5) for p, u in zip(names, made.expected(values, weights, len(names))) if u >= 0.5 or len(p) == 1}
            digamma = unigram._digamma(np.array([*share.values(), sum(share.values())]))
            scores = dict(zip(share, digamma[:-1] - digamma[-1]))
        if len(scores) <= room * 1.1:
            break
        names, values, made = lattice(words)
        used = np.zeros(len(names))
        for path, n in zip(made.best_paths(values), weights):
            for p in path:
                used[p] += n
        longer = [p for p in names if len(p) > 1]
        kept, losses = [p for p in names if len(p) == 1], []
        for piece, path in zip(longer, lattice(longer, skip_whole=True)[2].best_paths(values)):
            own = used[names.index(piece)]
            if not path:
                kept.append(piece)
            elif own > 0 and scores[piece] >= sum(values[p] for p in path):
                grown = np.log(used.sum() + own * (len(path) - 1))
                apart = sum(np.log(used[p] + own) - grown for p in path)
                losses.append((-round(own / used.sum() * (np.log(own) - np.log(used.sum()) - apart), 9), piece))
        target = max(int(room * 1.1), int(0.75 * len(names)))
        kept += [p for _, p in sorted(losses)[: max(target - len(kept), 0)]]
        if len(kept) == len(names):
            break
        scores = {p: scores[p] for p in kept}
    ranked = sorted(scores, key=lambda p: (len(p) > 1, -scores[p], p))
    return {p: scores[p] for p in ranked[: max(room, sum(len(p) == 1 for p in ranked))]}


@pytest.mark.parametrize("vocab_size, chunk_chars", [(60, 200_000), (60, 40), (200, 300)])
def test_unigram_equals_plain_learning(spark, monkeypatch, vocab_size, chunk_chars):
    monkeypatch.setattr(unigram, "CHUNK_CHARS", chunk_chars)
    draw = random.Random(5)
    syllables = ["ka", "to", "mi", "ren", "s", "ol", "\u00e9t"]
    counts = {"".join(draw.choices(syllables, k=draw.randint(1, 5))): draw.randint(1, 30) for _ in range(250)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    learned = unigram.learn_unigram(words, vocab_size, 8, 300)
    expected = plain_unigram(counts, vocab_size, 8, 300)
    assert set(learned.pieces) == set(expected)
    assert np.allclose(learned.scores, [expected[p] for p in learned.pieces], atol=1e-5)


def test_lattices_are_stored_in_rows_of_bounded_size(spark):
    words = spark.createDataFrame([("ab" * 2_000 + f"c{i}", 1) for i in range(30)] + [("ab" * 20_000, 1)], "word string, n long").coalesce(1)
    seeds = spark.createDataFrame([("a", 0), ("ab", 1), ("b", 2)], "piece string, number int")
    shared = spark.sparkContext.broadcast(seeds.toArrow())
    nodes = sorted(r["nodes"] for r in unigram._lattices(words, shared, 4, False).collect())
    assert nodes[-1] == 40_001 and nodes[-2] <= unigram.LATTICE_CHARS + unigram.LATTICE_WORDS
    assert sum(nodes) == 40_001 + sum(len(f"c{i}") + 4_001 for i in range(30))


def test_batches_are_bounded_for_a_while(spark):
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(k) for k in keys]
    with pytest.raises(ValueError), bounded_batches(spark, 10, 1_000):
        assert [spark.conf.get(k) for k in keys] == ["10", "1000"]
        with bounded_batches(spark, 20, 500):
            assert [spark.conf.get(k) for k in keys] == ["10", "500"]
        assert [spark.conf.get(k) for k in keys] == ["10", "1000"]
        raise ValueError
    assert [spark.conf.get(k) for k in keys] == before


def test_stored_lattices_leave_out_what_is_gone():
    pieces = ["a", "b", "ab", "ba", "aba"]
    scores = np.array([-1.0, -1.5, -0.7, -np.inf, -np.inf])
    alive, index = np.isfinite(scores), {p: i for i, p in enumerate(pieces)}
    columns = [column.split()[0] for column in unigram.STORED.split(", ")]
    words = ["abab", "b", "abaab", "aba"]
    rest = {p: i for p, i in index.items() if alive[i]}
    for kept in ([True] * 4, [True, False, True, False], [False] * 4):
        own = [w for w, k in zip(words, kept) if k]
        plain = unigram.Lattice(own, rest, 16)
        row = dict(zip(columns, unigram.Lattice(words, index, 16).row(np.arange(4))))
        stored = unigram.Lattice.stored(row, alive, np.array(kept))
        again = unigram.Lattice.stored(dict(zip(columns, stored.row(np.arange(len(own))))), alive)
        for lattice in (stored, again):
            assert lattice.best_paths(scores) == plain.best_paths(scores)
            weights = np.arange(1.0, len(own) + 1)
            assert np.allclose(lattice.expected(scores, weights, 5), plain.expected(scores, weights, 5))
            assert lattice.nodes == plain.nodes and lattice.piece.tolist() == plain.piece.tolist()


def test_unigram_of_no_words(spark):
    assert unigram.learn_unigram(spark.createDataFrame([], "word string, n long"), 50) == unigram.UnigramResult([], [])


def test_lattice_sums_by_brute_force():
    pieces = ["a", "b", "ab", "ba", "aba"]
    scores = [-1.0, -1.5, -0.7, -2.0, -1.1]
    index = {p: i for i, p in enumerate(pieces)}

    def paths(word):
        if not word:
            return [[]]
        return [[i, *rest] for p, i in index.items() if word.startswith(p) for rest in paths(word[len(p) :])]

    words, weights = ["abab", "b", "abaab"], np.array([2.0, 1.0, 3.0])
    expected = np.zeros(len(pieces))
    for word, n in zip(words, weights):
        chances = [np.exp(sum(scores[i] for i in path)) for path in paths(word)]
        for path, chance in zip(paths(word), chances):
            for i in path:
                expected[i] += n * chance / sum(chances)
    lattice = unigram.Lattice(words, index, 16)
    assert np.allclose(lattice.expected(np.array(scores), weights, len(pieces)), expected)
    best = [max(paths(w), key=lambda path: sum(scores[i] for i in path)) for w in words]
    assert lattice.best_paths(np.array(scores)) == best


def test_normalisers(spark):
    row = spark.createDataFrame([("  Éé  a,b!\n c\x1cd ", )], "t string")
    t = F.col("t")
    got = row.select(
        normalize_training(t, "nfc", True, "keep").alias("keep"),
        normalize_training(t, "none", False, "strip").alias("strip"),
        normalize_training(t, "nfc", True, "space").alias("space"),
        normalize_encoding(t, "none", False, "keep").alias("off"),
        normalize_encoding(t, "nfc", True, "keep").alias("on"),
    ).first()
    assert got["keep"] == "  éé  a,b!\n c\x1cd "
    assert got["strip"] == "Éé ab c d"
    assert got["space"] == "éé a b c d"
    assert got["off"] == "  Éé  a,b!\n c\x1cd "
    assert got["on"].startswith("éé a,b! c")


def test_config_checks():
    assert TokenizerConfig("bpe", 64, "nfc", False, "strip", 7).tokenizer_id == "bpe-64-nfc-nolower-strip-s7"
    for bad in (("x", 64), ("bpe", 5), ("bpe", 64, "nfd"), ("bpe", 64, "nfc", True, "drop")):
        with pytest.raises(DatasetError):
            TokenizerConfig(*bad)


def test_import_adds_missing_specials():
    model = TokenizerModel.from_json(
        {"model": {"type": "BPE", "vocab": {"<unk>": 0, "a": 1, "b": 2, "ab": 3}, "merges": ["a b"]}, "pre_tokenizer": {"type": "Whitespace"}}
    )
    assert model.tokens[:4] == ["<unk>", "a", "b", "ab"] and set(SPECIAL_TOKENS) <= set(model.tokens)


def test_train_and_inspect_jobs(spark, tmp_path):
    splits = {}
    for name, text in (("train", "Hello world"), ("dev", "dev sample"), ("test", "test sample")):
        path = tmp_path / f"{name}.jsonl"
        path.write_text(json.dumps({"task": "lm", "text": text}) + "\n")
        splits[name] = {"path": str(path)}
    splits["train"] = [splits["train"]]
    splits["gone"] = {"path": str(tmp_path / "gone.jsonl")}
    manifest = tmp_path / "dataset.manifest.json"
    manifest.write_text(json.dumps({"dataset_id": "toy", "splits": splits}))
    registry = str(tmp_path / "registry")
    trained = {}
    for algo in ("char", "bpe", "unigram"):
        config = TokenizerConfig(algo, 64)
        trained[algo] = train_tokenizer(spark, str(manifest), config, str(tmp_path / algo), registry)
        assert set(trained[algo]["report"]["per_split"]) == {"train", "dev", "test"}
        assert trained[algo]["manifest"]["source_dataset_id"] == "toy"
        assert len(trained[algo]["manifest"]["tokenizer_json_sha256"]) == 64
    runs = str(tmp_path / "runs")
    log = RunLog(spark, runs, "e", "again")
    train_tokenizer(spark, str(manifest), TokenizerConfig("bpe", 64), str(tmp_path / "again"), registry, run=log)
    assert {("algo", "bpe"), ("vocab_size", "64")} <= {(r["param"], r["value"]) for r in read_table(spark, runs, "params").collect()}
    assert "num_samples" in {r["metric"] for r in read_table(spark, runs, "metrics").collect()}
    names = [r["tokenizer_id"] for r in read_registry(spark, registry).collect()]
    assert sorted(names) == sorted({t["manifest"]["tokenizer_id"] for t in trained.values()})
    path = trained["bpe"]["tokenizer_path"]
    assert load_tokenizer(spark, path).tokens[:5] == list(SPECIAL_TOKENS)
    folders = encode_sequences(spark, path, str(manifest), str(tmp_path / "sequences"))
    coded_ids = read_sequences(spark, folders["dev"]).first()
    assert coded_ids["input_ids"][0] == 1 and coded_ids["input_ids"][-1] == 2
    assert coded_ids["attention_mask"] == [1] * len(coded_ids["input_ids"])
    report = inspect_tokenizer(spark, path, str(manifest), str(tmp_path / "inspect"))
    assert report["summary"]["num_samples"] == 3
    imported = train_tokenizer(spark, str(manifest), TokenizerConfig("bpe", 64), str(tmp_path / "ext"), external=path)
    assert imported["manifest"]["train_time_sec"] == 0.0
    manifest.write_text(json.dumps({"splits": {"dev": splits["dev"]}}))
    with pytest.raises(DatasetError):
        train_tokenizer(spark, str(manifest), TokenizerConfig("bpe", 64), str(tmp_path / "none"))


@pytest.mark.parametrize("size", [10, 1_000_000])
def test_vocabulary_lookup(spark, size):
    words = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "word string, n long")
    found = vocab.lookup_ids(words, vocab.top_words(words, 7), size, 3).collect()
    assert {r["word"]: r["id"] for r in found} == {"a": 5, "b": 6, "c": 3}


def test_latin_texts_are_normalised_and_cut_on_bytes(spark, monkeypatch):
    """F10, F16: texts up to U+00FF pass no pattern; words, byte counts and ids are those of the general path."""
    from corpusops.plans.tokenizer_job import training_words

    rng = random.Random(5)
    marks = [chr(c) for c in range(1, 256)]
    texts = ["", None, " ", "\u00a0\u0085", "  A\u00a0\u0085\tb ", "it's 'll 'sx ''re9 !'d\u00b2", "\u00c9\u00d7\u00df\u00ff \u00aa1\u00bd", "\u0130 \u65e5 a", "x <pad>Y", "<<pad", "pad>", "<p<eos>"]
    texts += ["".join(rng.choices(marks, k=rng.randint(1, 60))) for _ in range(200)]
    texts += ["".join(rng.choices("ab's\u00e9\u00c9 12\u00b2!?", k=rng.randint(1, 40))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, payload string").repartition(3)
    for lower, norm, sizes in ((True, "nfc", (7, 30, 300)), (False, "nfc", (30,)), (True, "none", (30,)), (False, "none", (30,))):
        def results():
            out = []
            for size in sizes:
                model = learn(rows, TokenizerConfig("char", size, norm, lower))
                out += [model.tokens, {r["n"]: r["input_ids"] for r in encode(rows, model).collect()}]
            model = TokenizerModel(TokenizerConfig("bpe", 300, norm, lower), [*SPECIAL_TOKENS, "a", "b", "ab"], merges=[("a", "b")])
            out.append({r["n"]: r["input_ids"] for r in encode(rows, model).collect()})
            return [*out, {r["word"]: r["n"] for r in training_words(rows, model.config, "payload").collect()}]

        found = results()
        with monkeypatch.context() as patch:
            patch.setattr(TokenizerConfig, "keeps_latin", False)
            assert found == results()


def test_ids_are_joined_like_arrays(spark):
    """the digests of ids need no string per id."""
    from corpusops.functions import arrays

    rows = spark.createDataFrame([(1, None), (2, []), (3, [7]), (4, [1, None, -20, 1]), (5, [None])], "n long, ids array<int>")
    both = rows.select(F.array_join("ids", " ").alias("a"), arrays.joined_ids(F.col("ids")).alias("b"))
    assert all(r["a"] == r["b"] for r in both.collect())


def test_guess_weighs_rare_words_by_those_left_out(spark, monkeypatch):
    """F16: rare words are in the guess by a share, so that it proposes what they are made of."""
    monkeypatch.setattr(bpe, "GUESS_WORDS", 40)
    rare = [(f"{i:04d}"[::-1] + "xy", 1) for i in range(2000)]
    base = spark.createDataFrame([*rare, *((f"{'ab' * (i + 1)}", 50 + i) for i in range(20))], "w string, n long")
    parts = bpe._sample(base, base.count())
    found = [(w, n) for b in parts for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert len({w for w, _ in found}) == len(found) <= 50
    assert {(w, n) for w, n in found if n >= 50 and w.startswith("a")} == {(f"{'ab' * (i + 1)}", 50 + i) for i in range(20)}
    assert 1000 < sum(n for w, n in found if w.endswith("xy")) < 3000


def test_alphabet_and_spelling_of_odd_words(spark):
    words = spark.createDataFrame([("a\U0001F600b",), ("",), ("\u65e5\u0130",)], "word string")
    letters = bpe.alphabet(words)
    assert letters == sorted("a\U0001F600b\u65e5\u0130")
    ids = {t: i for i, t in enumerate([*SPECIAL_TOKENS, *letters])}
    spelled = {r["word"]: r["s"] for r in words.select("word", bpe.spell(F.col("word"), ids).alias("s")).collect()}
    assert spelled == {w: "".join(bpe.symbol(ids[c]) for c in w) for w in spelled}
