"""Chunk dedup, SentencePiece, secret scans, token lengths: against libraries and plain Python."""

import hashlib
import random
import re
import struct
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from grantstar.llm.chunk_dedup import MOST_BYTES, cuts, gear_hashes, GEAR, repeated_spans, without_repeats
from grantstar.llm.secret_scan import (
    ACCESS,
    ASSIGN,
    HEX,
    KeyModels,
    SIZE,
    base_spans,
    candidates,
    digest_of,
    secret_spans,
    span_digests,
    steps,
)
from grantstar.llm.sentencepiece_codec import (
    CharacterMap,
    Codec,
    codec_digests,
    decode_documents,
    encode_documents,
)
from grantstar.llm.token_lengths import at_limit, context_limits, length_histogram, length_quantile, token_counter

from .conftest import EDGES, HUGE

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", " ", "  two  spaces ", "line\nends\n\n", "naïve café €", "😀 ok", "▁ already", "tab\tx", "a" * 500, "x \n y", "日本語 テスト"]


def syllables(r, n):
    return " ".join("".join(r.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(r.randint(1, 4))) for _ in range(n))


# --- chunks ------------------------------------------------------------------------------------


def test_gear_hash_equals_the_rolling_form():
    data = np.frombuffer(random.Random(0).randbytes(300), np.uint8)
    h, expected = 0, []
    for byte in data.tolist():
        h = (h << 1) + int(GEAR[byte]) & 0xFFFFFFFF
        expected.append(h)
    assert gear_hashes(data).tolist() == expected


def test_chunks_cover_the_text_and_survive_insertions():
    text = syllables(random.Random(1), 2000).encode()
    ends = cuts(text)
    assert ends[-1] == len(text) and all(0 < b - a <= MOST_BYTES for a, b in zip([0, *ends], ends))
    moved = cuts(text[:500] + b"inserted" + text[500:])
    assert len({e + 8 for e in ends} & set(moved)) > 0.8 * len(ends)
    assert cuts(b"") == [] and cuts(b"a" * 1000)[-1] == 1000


def test_shared_passages_are_found_and_clean_documents_left_alone(documents):
    r = random.Random(2)
    passage = syllables(r, 70)
    rows = [(i, f"{syllables(r, 80)} {passage} {syllables(r, 60)}" if i % 3 == 0 else syllables(r, 200)) for i in range(60)]
    got = {x.doc_id: x for x in repeated_spans(documents(rows)).collect()}
    assert set(got) == {i for i in range(60) if i % 3 == 0}
    for i, row in got.items():
        spans = b"".join(rows[i][1].encode()[s["start"] : s["end"]] for s in row.spans)
        assert all(part in passage.encode() for part in [spans[20:-20]])
    assert got[0].removed_bytes == 0 and got[3].removed_bytes == got[3].repeated_bytes > 0.6 * len(passage)
    cleaned = {x.doc_id: x.text for x in without_repeats(documents(rows)).collect()}
    assert cleaned[0] == rows[0][1] and cleaned[1] == rows[1][1]
    assert len(cleaned[3]) == len(rows[3][1]) - got[3].removed_bytes


def test_every_shared_passage_of_fifty_words_gives_a_span(documents):
    r = random.Random(5)
    shared = [syllables(r, r.randint(50, 60)) for _ in range(500)]
    shared = [p for p in shared if len(p) >= 256]
    assert len(shared) > 450
    around = lambda p: f"{syllables(r, r.randint(20, 60))} {p} {syllables(r, r.randint(20, 60))}"
    rows = [(2 * i + k, around(p)) for i, p in enumerate(shared) for k in (0, 1)]
    got = {x.doc_id: x.spans for x in repeated_spans(documents(rows)).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, text in rows:
        at = text.encode().index(shared[i // 2].encode())
        for span in got[i]:
            assert at - 16 <= span["start"] and span["end"] <= at + len(shared[i // 2]) + 16


def test_cuts_belong_to_a_text_and_not_to_an_id(documents):
    """Rows that share an id, or have none, lose what their own text repeats."""
    r = random.Random(17)
    passage, lone, other = syllables(r, 90), syllables(r, 200), syllables(r, 150)
    around = [f"{syllables(r, 40)} {passage} {syllables(r, 40)}" for _ in range(3)]
    rows = [(1, around[0]), (2, around[1]), (2, lone), (None, around[2]), (None, other)]
    docs = documents(rows).withColumn("cut_id", F.lit("x")).withColumn("cut_spans", F.lit(1))
    cleaned = sorted(x.text for x in without_repeats(docs).collect())
    assert lone in cleaned and other in cleaned and around[0] in cleaned
    shorter = [t for t in cleaned if t not in (lone, other, around[0])]
    assert len(shorter) == 2 and all(len(t) < len(around[1]) - 0.6 * len(passage) for t in shorter)
    spans = repeated_spans(docs).collect()
    assert sorted(str(x.doc_id) for x in spans) == ["1", "2", "None"]


def test_cuts_inside_a_character_take_it_whole(documents):
    r = random.Random(23)
    passage = "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(400))
    rows = [(1, "x" + passage), (2, "yy" + passage)]
    cleaned = {x.doc_id: x.text for x in without_repeats(documents(rows)).collect()}
    assert cleaned[1] == rows[0][1] and len(cleaned[2]) < len(passage) and "\ufffd" not in cleaned[2]


def test_edge_cases_of_chunks(edges, empty):
    rows = repeated_spans(edges).collect()
    assert {x.doc_id for x in rows} <= {4, 6} and repeated_spans(empty).collect() == []
    assert without_repeats(edges).count() == len(EDGES)


# --- SentencePiece -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_equal_the_library_and_spans_cover_the_text(library):
    codec = Codec(open(MODEL, "rb").read())
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice(" \nabé€😀▁thing") for _ in range(80)) for _ in range(200)]
    for text, (ids, spans) in zip(texts, codec.encode(texts)):
        assert ids == library.encode(text, add_bos=True, add_eos=True), text
        assert codec.decode(ids) == library.decode(ids)
        raw = text.encode()
        assert spans[0].tolist() == [0, 0] and spans[-1].tolist() == [len(raw)] * 2
        assert (spans[1:, 0] == spans[:-1, 1]).all()
        for (a, b), k in zip(spans[1:-1].tolist(), ids[1:-1]):
            piece = library.id_to_piece(k)
            if not library.is_byte(k):
                assert raw[a:b].decode().replace(" ", "▁") in (piece, piece[1:])


def compiled(mapping):
    """A character map as a double array, laid out by the first free place."""
    blob, at = b"", {}
    for value in set(mapping.values()):
        at[value] = len(blob)
        blob += value.encode() + b"\0"
    tree = {}
    for key, value in mapping.items():
        node = tree
        for byte in key.encode():
            node = node.setdefault(byte, {})
        node[None] = at[value]
    units, used = [0] * 4096, {0}

    def place(node, index, label):
        children = [0 if k is None else k for k in node]
        base = next(
            b
            for b in range(1, 4096)
            if all((b ^ c) not in used and (b ^ c) < 4096 for c in children) and (index ^ b) < 1 << 21
        )
        units[index] = (base ^ index) << 10 | (None in node) << 8 | label
        used.update(base ^ c for c in children)
        for k, child in node.items():
            if k is None:
                units[base] = child | 1 << 31
            else:
                place(child, base ^ k, k)

    place(tree, 0, 0)
    return struct.pack("<I", 4 * 4096) + struct.pack("<4096I", *units) + blob


MAPPING = {"ﬁ": "fi", "Ａ": "A", "ab": "X", "abc": "YZ", "\t": " ", "…": "...", "　": " ", "é": "e"}


@pytest.mark.parametrize("trim", [False, True])
@pytest.mark.parametrize("dummy", [False, True])
def test_normalisation_through_a_character_map_equals_the_library(trim, dummy):
    spec = sentencepiece_model_pb2.ModelProto.FromString(open(MODEL, "rb").read())
    spec.normalizer_spec.precompiled_charsmap = compiled(MAPPING)
    spec.normalizer_spec.remove_extra_whitespaces = trim
    spec.normalizer_spec.add_dummy_prefix = dummy
    model = spec.SerializeToString()
    theirs, mine = sentencepiece.SentencePieceProcessor(model_proto=model), Codec(model)
    r = random.Random(4)
    texts = ["", " ", "  ", "ﬁne ab abc abd…", "　Ａ　 ", "\tx\t\ty \n"]
    texts += ["".join(r.choice(["ﬁ", "Ａ", "a", "b", "c", "\t", " ", "…", "　", "é", "z", "日"]) for _ in range(30)) for _ in range(200)]
    for text, (ids, spans) in zip(texts, mine.encode(texts)):
        normal, to = mine.normalise(text.encode())
        assert normal.decode() == theirs.normalize(text), repr(text)
        assert ids == theirs.encode(text, add_bos=True, add_eos=True), repr(text)
        _, chars = theirs.normalize(text, with_offsets=True)
        if not normal:  # the library gives no place to a text that goes whole
            continue
        starts = [k for k, b in enumerate(normal) if b & 0xC0 != 0x80] + [len(normal)]
        assert [len(text.encode()[: to[k]].decode()) for k in starts] == list(chars)[: len(starts)], repr(text)
        assert (np.diff(spans[:, 0]) >= 0).all()


def test_longest_prefix_wins():
    characters = CharacterMap(compiled(MAPPING))
    assert characters.longest(b"abcd", 0) == (b"YZ", 3) and characters.longest(b"abd", 0) == (b"X", 2)
    assert characters.longest(b"zab", 0) is None and characters.longest(b"zab", 1) == (b"X", 2)
    assert not CharacterMap(b"")


def test_round_trip_and_digests_of_documents(edges, library):
    coded = encode_documents(edges, MODEL)
    back = decode_documents(coded, MODEL).collect()
    texts = sorted(str(t or "") for _, t, *_ in EDGES)
    assert sorted(r.text for r in back) == texts
    rows = {r.doc_id: r for r in codec_digests(edges, MODEL, with_ids=True).collect()}
    assert len(rows) == 9
    for doc_id, text, *_ in EDGES:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert rows[doc_id].ids == ids and rows[doc_id].n_tokens == len(ids)
        assert rows[doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_empty_tables(empty):
    assert encode_documents(empty, MODEL).collect() == [] and codec_digests(empty, MODEL).collect() == []


# --- secrets -----------------------------------------------------------------------------------


def plain_spans(text):
    out = []
    for m in re.finditer(ASSIGN, text, re.ASCII | re.IGNORECASE):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(ACCESS, text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(HEX, text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_fixed_patterns():
    r = random.Random(5)
    texts = ["password: token = abcdefgh", "API_KEY='abc123def'", "paſſword=abcdef", "AKIA" + "A" * 15, "AKIA" + "A" * 16]
    texts += ["".join(r.choice(["password", "Token", "=", ":", " ", '"', "abc", "0f" * 6, "AKIA", "Z9" * 4, "é"]) for _ in range(25)) for _ in range(400)]
    for text in texts:
        got = [(("assign", "access", "hex")[k], s, e) for s, k, e, _ in base_spans(text)]
        assert got == plain_spans(text), text


def test_models_tell_random_strings_from_identifiers(documents):
    r = random.Random(6)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def key(n):
        return "".join(r.choice(alphabet) for _ in range(n))

    rows = [(i, f"{syllables(r, 40)} {syllables(r, 12).replace(' ', '')} token={key(24)}") for i in range(200)]
    hidden = {300 + i: key(32) for i in range(50)}
    rows += [(i, f"see {k} and {syllables(r, 10).replace(' ', '')}") for i, k in hidden.items()]
    found = {x.doc_id: x for x in secret_spans(documents(rows)).collect()}
    caught = [i for i, k in hidden.items() if [(s.kind, s.start, s.end) for s in found[i].spans] == [("random", 4, 36)]]
    assert len(caught) >= 48
    assert all([s.kind for s in found[i].spans] == ["assign"] for i in range(200))


def test_counting_and_smoothing_of_the_models():
    counts = np.zeros((2, SIZE * SIZE))
    for value in ("abab", "abba"):
        for s in steps(value):
            counts[0, s] += 1
    for s in steps("x9Q7"):
        counts[1, s] += 1
    models = KeyModels.trained(counts)
    assert models.score("abab")[0] < 0 < models.score("x9Q7")[0]


def test_edge_cases_of_secrets(edges, empty, documents):
    assert secret_spans(empty).collect() == []
    rows = span_digests(secret_spans(edges)).collect()
    assert len(rows) == len(EDGES) and {r.base_sha256 for r in rows} == {digest_of([])}
    text = "x password=abcdef12 " + "0f" * 13
    row = span_digests(secret_spans(documents([(1, text)]))).first()
    assert (row.n_assign, row.n_access, row.n_hex) == (1, 0, 1)
    assert row.base_sha256 == digest_of(plain_spans(text)) and row.spans.startswith("assign:2:19,hex:20:46")


def test_candidates_are_found_in_linear_time():
    text = "0123456789abcdef0123456789 Zq8Yt5Rw2Xp9Lk4Jh7Gf " * 100_000
    began = time.monotonic()
    found = candidates(text, base_spans(text))
    assert time.monotonic() - began < 20 and len(found) == 100_000
    assert found[1] == (48 + 27, "Zq8Yt5Rw2Xp9Lk4Jh7Gf")


def test_candidates_touch_no_fixed_pattern():
    r = random.Random(18)
    for _ in range(300):
        text = "".join(r.choice(["token=", "Ab3", "0f" * 13, "AKIA", "Z9" * 9, " ", "é", "k-_/" * 5]) for _ in range(20))
        spans = base_spans(text)
        brute = [
            (m.start(), m[0])
            for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text)
            if re.search("[A-Za-z]", m[0]) and not any(s < m.end() and m.start() < e for s, _, e, _ in spans)
        ]
        assert candidates(text, spans) == brute


# --- token lengths -----------------------------------------------------------------------------


def test_histogram_answers_every_limit(documents):
    r = random.Random(7)
    texts = [syllables(r, r.randint(0, 400)) for _ in range(120)] + [None, "", "x"]
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = sorted(len(encoding.encode_ordinary(t or "")) for t in texts)
    docs = documents(list(enumerate(texts)), clashing=True)
    limits = context_limits(length_histogram(docs, RANKS, public_tokenizers.PATTERN)).cache()
    rows = limits.collect()
    assert sorted(x.length for x in rows) == sorted(set(lengths))
    for x in rows:
        assert x.docs == lengths.count(x.length)
        assert x.docs_upto == sum(n <= x.length for n in lengths) and x.docs_over == sum(n > x.length for n in lengths)
        assert x.tokens_kept == sum(min(n, x.length) for n in lengths)
        assert x.tokens_kept + x.tokens_lost == sum(lengths)
    for limit in (0, 77, 500, 100_000):
        assert at_limit(limits, limit).first().tokens_kept == sum(min(n, limit) for n in lengths)
    for share in (0.1, 0.5, 1.0):
        k = next(n for n in lengths if sum(x <= n for x in lengths) >= share * len(lengths))
        assert length_quantile(limits, share).first().length == k


def test_long_runs_of_white_space_are_encoded_as_the_library_does():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    count = token_counter(ranks, public_tokenizers.PATTERN)
    r = random.Random(19)
    white = [" ", "\n", "\t", " \n", "\u3000", "\r\n", "\x85"]
    texts = ["", " " * 5000, "a" + " " * 5000, "a" + " " * 4096 + "b", "\n" * 9000 + ".", " " * 5000 + "'s"]
    for _ in range(60):
        parts = [r.choice(["word", "12", "!", " x", "'ll", *(w * r.choice([1, 2, 2100, 5000]) for w in white)]) for _ in range(8)]
        texts.append("".join(parts))
    for text in texts:
        assert count(text) == len(encoding.encode_ordinary(text)), repr(text[:40])
    assert count(" " * 2_000_000) > 0 and count("x" * 300_000) > 0


def test_very_long_runs_pass_every_operator_of_this_file(huge):
    assert repeated_spans(huge).count() >= 0 and without_repeats(huge).count() == len(HUGE)
    assert codec_digests(huge, MODEL).count() == len(HUGE)
    assert span_digests(secret_spans(huge)).count() == len(HUGE)
    limits = context_limits(length_histogram(huge, RANKS, public_tokenizers.PATTERN))
    assert limits.agg(F.sum("docs")).first()[0] == len(HUGE)


def test_empty_histogram(empty, edges):
    assert context_limits(length_histogram(empty, RANKS, public_tokenizers.PATTERN)).collect() == []
    rows = context_limits(length_histogram(edges, RANKS, public_tokenizers.PATTERN))
    assert rows.agg(F.sum("docs")).first()[0] == len(EDGES)
