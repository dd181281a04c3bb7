import random

import numpy as np
import pytest
from support import DATA
from tokenizers import Tokenizer, models

from citeloom.llm import piece_encoding, token_counts, token_output
from citeloom.llm.common import mix64
from citeloom.llm.vocabulary import default_path, load


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()] + ["", "   ", "a  b\n\n\tc", "日本 🚀 é", "x" * 5000, " lead", "I'm we've 12ab"]


def by_text(encoder, texts, keys):
    ids, lengths = encoder.encode_texts(texts, keys)
    return [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]


def test_plain_pieces_are_the_librarys(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=default_path())
    encoder = piece_encoding.Encoder(default_path(), dropout=0.0)
    for text, ids in zip(texts, by_text(encoder, texts, [1] * len(texts)), strict=True):
        assert ids == sp.encode(text)


def plain_agenda(encoder, word, key):
    """One word, the agenda a plain list, each candidate drawn by its place and end."""
    v, own = encoder.vocabulary, [(i, i + 1, c) for i, c in enumerate(word)]
    skipped = set()
    while True:
        found = []
        for (a, b, x), (_, d, y) in zip(own, own[1:], strict=False):
            if x in v.id_of and y in v.id_of and x + y in v.id_of and (a, b, d) not in skipped:
                found.append((-v.scores[v.id_of[x + y]], a, b, d, x + y))
        if not found:
            break
        # of equal scores the smaller id goes first, as in the tables
        _, a, b, d, piece = min(found, key=lambda f: (f[0], v.id_of[f[4]], f[1]))
        h = int(mix64(np.array([key ^ (a << 32) ^ d], np.uint64))[0])
        if (h >> 11) < int(encoder.dropout * float(1 << 53)):
            skipped.add((a, b, d))
            continue
        own = [w for w in own if w[0] not in (a, b)] + [(a, d, piece)]
        own.sort()
    out = []
    for _, _, piece in own:
        out += [v.id_of[piece]] if piece in v.id_of else [int(v.byte_id[b]) for b in piece.encode()]
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5])
def test_dropout_runs_as_a_plain_agenda(dropout):
    encoder = piece_encoding.Encoder(default_path(), dropout=dropout)
    text = "international understanding of the é日 beginnings " * 6 + "ab" * 200 + " donaudampfschifffahrt"
    segments = encoder.vocabulary.segments("▁" + text.replace(" ", "▁"))
    keys = encoder.word_keys(9, len(segments))
    want = [plain_agenda(encoder, w, int(k)) for w, k in zip(segments, keys, strict=True)]
    assert by_text(encoder, [text], [9])[0] == sum(want, [])


def test_dropout_varies_and_decodes(texts):
    texts = [*texts, "▁", "a▁▁ b ▁"]
    encoder = piece_encoding.Encoder(default_path(), dropout=0.3)
    one, again, other = (by_text(encoder, texts, [k] * len(texts)) for k in (5, 5, 60_000))
    assert one == again and one != other and one != by_text(piece_encoding.Encoder(default_path(), dropout=0.0), texts, [5] * len(texts))
    for text, ids in zip(texts, one, strict=True):
        assert encoder.decode(np.array(ids, np.int64)) == text.encode()
    all_skipped = by_text(piece_encoding.Encoder(default_path(), dropout=1.0), ["abc de"], [0])[0]
    assert len(all_skipped) == len("▁abc▁de")


def test_lossless_sees_every_wrong_text(texts):
    encoder = piece_encoding.Encoder(default_path(), dropout=0.3)
    ids, lengths = encoder.encode_texts(texts, [1] * len(texts))
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    joined = np.frombuffer(b"".join(raw), np.uint8).copy()
    assert encoder.lossless(ids, lengths, joined, offs).all()
    joined[offs[3]] ^= 1
    assert np.flatnonzero(~encoder.lossless(ids, lengths, joined, offs)).tolist() == [3]
    raw[5] += b"x"
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    assert np.flatnonzero(~encoder.lossless(ids, lengths, np.frombuffer(b"".join(raw), np.uint8), offs)).tolist() == [5]


def test_dropout_draws_each_occurrence():
    encoder = piece_encoding.Encoder(default_path(), dropout=0.3)
    words = [" international"] * 400 + [" of", " " + "ab" * 200, " é日"] * 20
    got = by_text(encoder, ["".join(words)[1:]], [11])[0]
    segments = encoder.vocabulary.segments("".join(words).replace(" ", "▁"))
    alone, _ = zip(*[encoder.encode_words([s], encoder.word_keys(11, len(segments))[i : i + 1]) for i, s in enumerate(segments)], strict=True)
    assert got == np.concatenate([x.values for x in alone]).tolist() and len({x.values.tobytes() for x in alone[:400]}) > 8
    # what is remembered is let go beyond its bound, and nothing changes
    encoder.known.limit = 2
    assert [by_text(encoder, ["".join(words)[1:]], [11])[0] for _ in range(2)] == [got, got]


def test_copies_are_segmented_apart(spark):
    docs = spark.createDataFrame([(1, "international understanding " * 30)] * 3, "doc_id long, text string").coalesce(1)
    got = piece_encoding.encode_pieces(docs, apart=True).collect()
    assert len({r.ids_crc32 for r in got}) == 3 and all(r.lossless for r in got)
    assert len({r.ids_crc32 for r in piece_encoding.encode_pieces(docs).collect()}) == 1


def test_copies_are_apart_however_they_lie(spark):
    text = "international understanding " * 30
    docs = [(1, text)] * 6 + [(None, text)] * 3 + [(2, "another text of some words")] * 2 + [(3, None)] * 2
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    results = []
    for parts in (1, 3, 9):
        got = piece_encoding.encode_pieces(frame.repartition(parts), apart=True).collect()
        results.append(sorted((repr(r.doc_id), r.ids_crc32 or 0) for r in got))
        assert len({r.ids_crc32 for r in got if r.doc_id == 1}) == 6
    assert results[0] == results[1] == results[2]


def test_piece_encoding_of_odd_rows(odd, empty):
    got = piece_encoding.encode_pieces(odd).toPandas()
    assert len(got) == odd.count() and got[got.doc_id != 2].lossless.all()
    assert got[got.doc_id == 2].n_tokens.isna().all() and (got[got.doc_id == 3].n_tokens == 0).all()
    assert piece_encoding.encode_pieces(empty).count() == 0


def test_counts_are_those_of_a_unigram_tokenizer(texts):
    v = load(default_path())
    library = Tokenizer(models.Unigram(list(zip(v.pieces, v.scores, strict=True)), unk_id=0, byte_fallback=True))
    counter = token_counts.Counter(default_path())
    for text in texts:
        assert counter.count(text) == (len(library.encode("▁" + text.replace(" ", "▁")).ids) if text else 0)


def test_counts_of_odd_rows(odd, empty):
    got = token_counts.token_counts(odd).toPandas().set_index("doc_id").n_tokens
    assert len(got) == odd.count() and np.isnan(got[2]) and got[3] == 0 and got[7] > 0
    assert token_counts.token_counts(empty).count() == 0


ODD_TEXTS = [
    "hello <|endoftext|> world", "<|endoftext|>", "a <|endoftext", "|>", "a  b\n\n\tc \n d", "I'm we've 12ab don't 'S", "  lead", "trail  ", "", " ", "a\u180e b\u200b c", "\xa0 x\xa0", "½ x² ª",
    "naïve 日本 'll x'", "\x1c a", "a\x00b", "x" * 5000, "日本語のテキスト " * 40, "мир и война, 'мир'", "مرحبا بالعالم",
]


def test_ids_are_the_librarys(texts):
    path = default_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    encoder = token_output.TextEncoder(path)
    texts = [*texts, *ODD_TEXTS]
    for limit in (450_000, 5):  # also when what is remembered is let go
        encoder.known.limit = limit
        for at in range(0, len(texts), 7):
            ids, lengths = encoder.encode(texts[at : at + 7])
            for text, own in zip(texts[at : at + 7], np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
                assert own.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_pre_tokens_of_plain_texts_are_the_librarys():
    g = random.Random(4)
    path = default_path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), token_output.TextEncoder(path)
    signs = ["'", "s", "t", "re", "ll", "ve", "m", "d", "'S", " ", "  ", "\n", "\t", "\r", "a", "é", "ɏ", "7", ".", "!!", " the", "日"]
    for _ in range(100):  # many small batches, some without a plain text
        texts = ["".join(g.choices(signs, k=g.choice([0, 1, 2, 3, 5, 12, 40]))) for _ in range(g.randrange(5))]
        ids, lengths = encoder.encode(texts)
        assert len(lengths) == len(texts)
        for text, own in zip(texts, np.split(ids, np.cumsum(lengths)[:-1]), strict=False):
            assert own.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_random_strings_have_the_librarys_ids():
    g = random.Random(3)
    path = default_path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), token_output.TextEncoder(path)
    alphabet = "ab 'st\n\t .,!09éÀ\xa0日\u2028ʼª \u180e"
    texts = ["".join(g.choice(alphabet) for _ in range(g.randrange(1, 30))) for _ in range(4000)]
    ids, lengths = encoder.encode(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
        assert own.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("kind", ["zipf", "one", "wide"])
@pytest.mark.parametrize("lengths", [[0], [1], [5, 0, 7], [token_output.BLOCK], [token_output.BLOCK + 1, 3], [9000, 1]])
def test_groups_round_trip(lengths, kind):
    g = np.random.default_rng(sum(lengths))
    n = sum(lengths)
    ids = {"zipf": g.zipf(1.3, n) % 50_257, "one": np.full(n, 7), "wide": g.integers(0, 1 << 32, n)}[kind].astype(np.uint32)
    names = [None if i == 0 else i * 7 - 3 for i in range(len(lengths))]
    got, sizes, flat = token_output.unpack_group(token_output.pack_group(names, ids, np.array(lengths)))
    assert got == names and sizes.tolist() == lengths and flat.tolist() == ids.tolist()


def test_blocks_stand_alone_and_share_the_orders(monkeypatch):
    # text-like ids: every order tells something
    g = np.random.default_rng(5)
    step = g.integers(0, 300, (300, 3))
    ids = [0]
    for k in g.integers(0, 3, 60_000).tolist():
        ids.append(int(step[ids[-1], k]))
    ids = np.array(ids, np.uint32)
    data = token_output.pack_group([1], ids, np.array([len(ids)]))
    assert 8 * len(data) / len(ids) < 0.5 * np.log2(300)
    monkeypatch.setattr(token_output, "DIRECT", 0)  # the entries found by search are the same
    assert token_output.pack_group([1], ids, np.array([len(ids)])) == data
    order0 = token_output.Order0(*np.unique(ids, return_counts=True))
    ranks = np.searchsorted(order0.ids, ids).astype(np.int32)
    previous = np.concatenate([[len(order0.ids)], ranks[:-1]])
    previous[:: token_output.BLOCK] = len(order0.ids)
    order1, entry = token_output.Order1.learn(order0, ranks, previous)
    words, sizes = token_output.code_blocks(ranks, entry, order0, order1)
    at = int(sizes[:2].sum())
    third = token_output.decode_blocks(words[at : at + sizes[2]], sizes[2:3], token_output.BLOCK, order0, order1)
    assert third.tolist() == ranks[2 * token_output.BLOCK : 3 * token_output.BLOCK].tolist()


def test_too_many_distinct_ids_are_refused():
    n = 1 << 18
    with pytest.raises(ValueError, match="distinct"):
        token_output.pack_group([1], np.arange(n, dtype=np.uint32), np.array([n]))


def test_repeats_compress_and_damage_is_found():
    ids = np.tile(np.arange(100, 140), 400).astype(np.uint32)
    data = token_output.pack_group([1], ids, np.array([len(ids)]))
    assert len(data) < 4 * len(ids) / 20
    for at in (10, 100, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(Exception):  # noqa: B017
            token_output.unpack_group(bytes(bad))


def test_token_table(spark, odd, empty, tmp_path):
    import zlib

    token_output.write_tokens(odd, str(tmp_path / "t"))
    got = token_output.token_table(spark, str(tmp_path / "t")).orderBy("start").collect()
    library = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    expected = sorted((-1 if r.doc_id is None else r.doc_id, zlib.crc32((r.text or "").encode()), library.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in odd.collect())
    at = 0
    for row, (doc_id, _, ids) in zip(got, expected, strict=True):
        assert (-1 if row.doc_id is None else row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    token_output.write_tokens(empty, str(tmp_path / "e"))
    assert token_output.token_table(spark, str(tmp_path / "e")).count() == 0


def test_new_words_of_one_kind_need_no_pre_tokenizer(monkeypatch):
    path = default_path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), token_output.TextEncoder(path)
    asked, real = [], encoder._asked
    monkeypatch.setattr(encoder, "_asked", lambda surfaces: asked.append((encoder.tokenizer.pre_tokenizer.__class__.__name__, list(surfaces))) or real(surfaces))
    words = [" some", " words", " 1984", " ...", " ós", " a, b", " 's", " <|endoftext|>", "x", "Ġ", " Ġa", " end"]
    ids, lengths = encoder.library(words)
    for word, own in zip(words, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
        assert own.tolist() == library.encode(word, add_special_tokens=False).ids, word
    assert asked[0] == ("Split", ["Ġsome" + "Ġwords" + "Ġ1984" + "Ġ..." + "Ġend"]) and all(kind == "ByteLevel" for kind, _ in asked[1:])


def test_places_of_order_0_are_found_without_a_search():
    g = np.random.default_rng(8)
    counts = np.concatenate([g.integers(1, 4, 5000), g.integers(100, 9000, 50)])
    order0 = token_output.Order0(np.arange(len(counts)), counts)
    keys, many = np.arange(60, dtype=np.int64), np.full(60, 7)
    order1 = token_output.Order1(len(counts), keys, many, np.ones(len(counts) + 1, np.uint8))
    table = token_output.Entries(order0, order1, order0.bits - token_output.ORDER1_BITS)
    places = order1.total + (np.arange(1 << order0.bits) << token_output.BUCKET_BITS)
    found = table.bucket[places >> token_output.BUCKET_BITS]
    assert (table.rank[found] == np.repeat(np.arange(len(counts)), order0.freq)).all() and (found == table.entry_at(places)).all()
    inside = np.arange(order1.total)
    assert (table.rank[table.entry_at(inside)] == np.repeat(order1.rank, order1.freq)).all()


def some_words(n, seed):
    g = random.Random(seed)
    return ["".join(g.choices("ab é", k=g.randrange(1, 9))) for _ in range(n)]


def arrays_of(words):
    raws = [w.encode() for w in words]
    sizes = np.array([len(r) for r in raws])
    return token_output.ShortWords.of(b"".join(raws), np.cumsum(sizes) - sizes, sizes)


@pytest.mark.parametrize("one_slot", [False, True])
def test_short_words_are_known_by_their_bytes(monkeypatch, one_slot):
    if one_slot:  # all words meet in the table
        monkeypatch.setattr(token_output.ShortWords, "_slot", lambda self, first, second: np.zeros(len(first), np.int64))
    table, asked = token_output.ShortWords(40), []

    def ids_of(rows):
        new = [bytes(r[r > 0]).decode() for r in rows]
        asked.extend(new)
        return np.concatenate([np.frombuffer(w.encode(), np.uint8).astype(np.uint32) for w in new]), np.array([len(w.encode()) for w in new])

    for seed in range(6):  # also when words are let go, and more than the table was made for
        words = some_words([30, 30, 500, 2, 200, 1][seed], seed) + ["x" * 16, "x" * 15, "x", "x" * 8, "x" * 9]
        before = len(asked)
        numbers = table.find(*arrays_of(words), ids_of)
        values, lengths = table.runs.take(numbers)
        assert [bytes(v.astype(np.uint8)).decode() for v in np.split(values, np.cumsum(lengths)[:-1])] == words
        assert len(set(asked[before:])) == len(asked[before:]) and len(table.first) == len(table.runs.lengths) == len(table.uses)
    before = len(asked)
    table.find(*arrays_of(["x", words[0]]), ids_of)
    assert len(asked) == before  # those asked for last are remembered


def test_short_words_are_sent_as_pieces_spell_them(monkeypatch, texts):
    path = default_path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), token_output.TextEncoder(path)
    asked, real = [], encoder._asked
    monkeypatch.setattr(encoder, "_asked", lambda surfaces: asked.append((encoder.tokenizer.pre_tokenizer.__class__.__name__, list(surfaces))) or real(surfaces))
    text = "Los años 1984 ... über it's  ok"
    ids, _ = encoder.encode([text])
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    split = [s for kind, s in asked if kind == "Split" and s]
    assert len(split) == 1 and sorted(split[0][0].split("Ġ")[1:]) == sorted(["aÃ±os", "1984", "...", "Ã¼ber", "it", "ok"]) and len(encoder.known) == 0
    encoder.short.limit = 5
    for at in range(0, len(texts), 7):
        ids, lengths = encoder.encode(texts[at : at + 7])
        for one, own in zip(texts[at : at + 7], np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
            assert own.tolist() == library.encode(one, add_special_tokens=False).ids, one


def test_pieces_over_a_border_do_not_join_words(tmp_path):
    from tokenizers import pre_tokenizers

    vocabulary = {c: i for i, c in enumerate(["Ġ", "a", "b", "aĠ", "Ġa", "Ġb", "Ġab", "ab"])}
    made = Tokenizer(models.BPE(vocabulary, [("a", "Ġ"), ("a", "b"), ("Ġ", "ab"), ("Ġ", "a"), ("Ġ", "b")]))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    path = str(tmp_path / "over.json")
    made.save(path)
    text = " a b ab a a ba"
    ids, _ = token_output.TextEncoder(path).encode([text])
    assert ids.tolist() == made.encode(text, add_special_tokens=False).ids


def test_buckets_begin_where_a_search_would():
    g = np.random.default_rng(9)
    order0 = token_output.Order0(np.arange(3000), g.integers(1, 900, 3000))
    keys = np.unique(g.integers(0, 3000 * 3000, 20_000))
    order1 = token_output.Order1(3000, keys, g.integers(1, 50, len(keys)), np.ones(3001, np.uint8))
    table = token_output.Entries(order0, order1, order0.bits - token_output.ORDER1_BITS)
    begin = np.append(0, table.next[:-1])
    places = np.arange(len(table.bucket)) << token_output.BUCKET_BITS
    assert (table.bucket == np.searchsorted(begin, places, side="right") - 1).all()
    assert places[-1] == order1.total + (1 << order0.bits + token_output.BUCKET_BITS)


@pytest.mark.parametrize("n", [0, 1, token_output.BLOCK, 3 * token_output.BLOCK, 40 * token_output.BLOCK + 7])
def test_blocks_are_turned_into_steps(n):
    values, lanes = np.arange(1, n + 1, dtype=np.int32), -(-n // token_output.BLOCK)
    got = token_output._by_step(values, lanes)
    assert got.shape == (token_output.BLOCK, lanes) and got.flags.c_contiguous and got.T.ravel()[:n].tolist() == values.tolist()
    assert not got.T.ravel()[n:].any()
