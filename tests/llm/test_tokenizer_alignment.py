import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimspan.llm import tokenizer_alignment as t

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
           "groups_sha256"]
ODD = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "one  two\n\nthree"), (5, "one  two\n\nthree"),
       (6, "<|endoftext|> <s> </s> <unk>"), (7, "▁ looks like a space"), (8, "naïve 漢字 😀 Ω"),
       (9, "\x00 \x1f \x85 nul"), (10, "the the the the"), (None, "no id, the the"),
       (11, "a" * 300_000), (12, " " * 5_000 + "x"), (13, "é" * 40_000 + " the")]


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(f"{t.TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{t.TOKENIZERS}/{t.PIECES}")


def byte_alphabet():
    """Characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(rows, encoders):
    """The contract, with the vocabulary's own library and plain Python."""
    a, b = encoders
    alphabet = byte_alphabet()

    def piece(i):
        text = b.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if b.is_byte(i) else text.replace("▁", " ").encode()

    linked, told = Counter(), []
    for doc, text in rows:
        whole = (" " + text).encode() if text else b""
        in_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        in_b = b.encode(text) if text else []
        of_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in in_a]
        of_b = [piece(i) for i in in_b]
        if b"".join(of_a) != whole or b"".join(of_b) != whole:
            in_a, in_b, of_a, of_b = [], [], [], []
        ends = [dict(zip(np.cumsum([len(x) for x in of]).tolist(), ids))
                for of, ids in ((of_a, in_a), (of_b, in_b))]
        both = sorted(ends[0].keys() & ends[1].keys())
        pairs = [(ends[0][e], ends[1][e]) for e in both]
        linked.update(pairs)
        groups, last = [], 0
        for end in both:
            groups.append("|".join(",".join(str(of[e]) for e in sorted(of) if last < e <= end)
                                   for of in ends) if len(both) < 2_000 else None)
            last = end
        told.append((doc, len(in_a), len(in_b), pairs,
                     None if None in groups else ";".join(groups)))
    most = defaultdict(int)
    for (_, y), n in linked.items():
        most[y] = max(most[y], n)
    return linked, [(doc, n_a, n_b, len(pairs), len(pairs),
                     sum(linked[p] == most[p[1]] for p in pairs), sum(linked[p] for p in pairs),
                     groups if groups is None else
                     hashlib.sha256(groups.encode()).hexdigest() if pairs else "")
                    for doc, n_a, n_b, pairs, groups in told]


def same(got, expected):
    got = sorted(map(tuple, got), key=str)
    for ours, theirs in zip(got, sorted(expected, key=str), strict=True):
        assert ours[:7] == theirs[:7]
        assert theirs[7] is None or ours[7] == theirs[7]


def test_odd_rows_and_small_blocks(make, encoders, monkeypatch):
    _, expected = brute(ODD, encoders)
    out = t.alignment(make(ODD))
    assert out.columns == COLUMNS
    same(out.collect(), expected)
    same(t.alignment(make(ODD), block_bytes=1).collect(), expected)
    monkeypatch.setattr(t, "BLOCK_DOCS", 2)
    same(t.alignment(make(ODD).coalesce(1)).collect(), expected)
    assert t.report(make([])).collect() == []
    assert t.aligned_pairs(make([(1, None)])).collect() == []


def test_whole_table(spark, documents, encoders):
    from claimspan.llm.queries import QUERIES
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    linked, expected = brute(rows, encoders)
    same(QUERIES["op11_alignment"](spark, "/root/testdata/sf0.001").collect(), expected)
    pairs = t.aligned_pairs(documents)
    assert {(r.a, r.b): r.n_links for r in pairs.collect()} == linked
    shares = pairs.groupBy("b").agg(F.sum("share").alias("s"), F.max("best").alias("m"))
    assert shares.where("abs(s - 1) > 1e-9 or not m").isEmpty()


def test_document_counts(make, encoders):
    pairs = {(r.a, r.b): (r.n_docs, r.n_links) for r in t.aligned_pairs(make(
        [(i, "the the the") for i in range(40)] + [(99, "the")])).collect()}
    assert list(pairs.values()) == [(41, 121)]


def test_bitmaps_give_their_documents_back():
    rng = np.random.default_rng(3)
    for documents in (1, 7, 300, 65_536):
        sets = {pair: np.flatnonzero(rng.random(documents) < share)
                for pair, share in enumerate((0.0, 0.003, 0.2, 0.9, 1.0))}
        pair = np.concatenate([np.full(len(m), p) for p, m in sets.items()])
        found = {}
        for pairs, ones, dense, docs in t.bitmaps(
                pair, np.concatenate(list(sets.values())), documents):
            member, row = t.members(docs, np.full(len(pairs), dense))
            for i, p in enumerate(pairs.tolist()):
                found[p] = member[row == i].tolist()
                assert len(found[p]) == ones[i]
        assert found == {p: m.tolist() for p, m in sets.items() if len(m)}


def test_both_byte_level_files_agree(encoders):
    """On every letter, digit and sign up to the end of the basic plane."""
    use = t.tokenizers()
    texts = ["".join(f" {chr(c)}{chr(c)}a1{chr(c)}\n" for c in range(i, i + 64)
                     if not 0xD800 <= c < 0xE000) for i in range(0, 0x10000, 64)]
    theirs = encoders[0].encode_batch([" " + x for x in texts], add_special_tokens=False)
    ours = [use._byte_level.encode_ordinary(" " + x) for x in texts]
    assert ours == [e.ids for e in theirs]
