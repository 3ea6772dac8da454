"""Filter audit, spelling forms and piece coding against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from ledgerlens.llm import filter_audit as A
from ledgerlens.llm import piece_coding as C
from ledgerlens.llm import queries
from ledgerlens.llm import spelling as S
from tests.llm.tables import awkward, collect, documents, words


# Filter audit

def slow_audit(rows, labels):
    firsts = {}
    for i, t, _ in rows:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    marks = {}
    for i, q, x in labels:
        good, toxic = marks.get(i, (False, False))
        marks[i] = (good or q == 1, toxic or x == 1)
    failed = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = ("A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w))
                 + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t))
                 + "D" * bool(re.search("[#$%&*|]", t))
                 + "E" * (i is not None and i > firsts[t]))
        failed.append((part or "", fails, *(marks.get(i, (0, 0)) if i is not None else (0, 0))))
    out = {}
    for part in {f[0] for f in failed}:
        mine = [f for f in failed if f[0] == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                shapley[letter] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(letter in f[1] for f in mine) - len(gone),
                    sum(f[1] == letter for f in mine), sum(bool(f[2]) for f in gone),
                    sum(bool(f[3]) for f in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def audited(spark, rows, labels):
    got = A.filter_audit(documents(spark, rows), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int"))
    return {(r["part"], r["filter_order"], r["step"]): [
        r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
                       "shapley")] for r in collect(got)}


def test_audit_of_awkward_rows(spark):
    rows = awkward()
    for k in range(60):
        w = words(k, 150 + 3 * k, 40 if k % 3 else 3000)
        text = " ".join(w) + (" $5" if k % 4 == 0 else "") + ("ABCDE" * k if k % 5 == 0 else "")
        rows += [(100 + k, text, "abcä"[k % 4])] + [(300 + k, text, None)] * (k % 3)
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 400, 2)] \
        + [(102, 1, 0), (102, 0, 1), (104, None, None), (None, 1, 1)]
    labels = [(i, q, None if x is None else int(x)) for i, q, x in labels]
    assert audited(spark, rows, labels) == slow_audit(rows, labels)


def test_audit_of_few_or_no_rows(spark):
    assert audited(spark, [], []) == {}
    clean = [(1, " ".join(words(9, 300)), "p")]
    got = audited(spark, clean, [])
    assert len(got) == 600 and all(v == [1, 0, 0, 0, 0, 0, 0] for v in got.values())


def test_intervals_cover_each_order_once():
    names = A.orders()
    for failed in range(1, 32):
        at = {}
        for f, step, rank, sign in A.interval_ends():
            if f == failed and sign == 1:
                at.setdefault(step, []).append(rank)
        covered = Counter()
        for f, step, rank, sign in A.interval_ends():
            if f == failed:
                for r in range(rank, len(names)):
                    covered[r, step] += sign
        for r, order in enumerate(names):
            first = min(order.index(x) + 1 for i, x in enumerate("ABCDE") if failed >> i & 1)
            assert [covered[r, s] for s in range(1, 6)] == [int(s == first) for s in range(1, 6)]


@pytest.mark.parametrize("block", [1, 2, 5, 1 << 20])
def test_words_block_by_block(block):
    text = b" a bb\x0b\x0ca bb  ccc\r\n" + b"d" * 40 + b" a\x85 \xc2\xa0 e"
    w = text.split()
    assert A.word_counts(text, block) == (len(w), len(set(w)))


# Spelling forms

def slow_words(rows):
    found = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_forms(counts):
    form, n_near = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        n_near[w] = len(others)
        best = min(others, key=lambda x: (-counts[x], x.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, n_near[w], counts.get(form[w])))
    return out


def as_rows(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"])
            for r in collect(df)}


def test_words_of_awkward_rows(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdéÿ×") for _ in range(rng.randrange(4, 9)))
                  for _ in range(300)]
    rows = awkward() + [(k, " ".join(rng.choice(vocabulary).title() + rng.choice(["", "-", "9"])
                                     for _ in range(120)), "s") for k in range(80)]
    rows += [(500 + k, "Übermut " + "z" * 3000, "s") for k in range(4)]
    got = {r["word"]: r["n"] for r in collect(S.word_counts(documents(spark, rows)))}
    assert got == slow_words(rows) and "z" * 3000 in got


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_runs_block_by_block(block):
    text = "Ab cdé×ÿ, xx9yy Ab" + "q" * 30 + " "
    assert S.runs(text, block) == S.runs(text)


def test_forms_by_brute_force(spark):
    rng = random.Random(5)
    letters = "abÿ"
    counts = {}
    for _ in range(500):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(5, 9)))
        counts[w] = rng.choice([3, 4, 6, 8, 12, 24, 100])
    counts |= {"aaaaa": 50, "aaaaaa": 50, "aaaaaaa": 200, "abcde": 3, "abcdef": 6, "bcdef": 3,
               "z" * 3000: 7, "z" * 2999: 14, "lonely": 9}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_rows(S.spelling_forms(words)) == slow_forms(counts)


def test_forms_of_no_words(spark):
    assert as_rows(S.spelling_forms(spark.createDataFrame([], "word string, n long"))) == set()


def test_forms_of_documents(spark):
    rows = [(k, " ".join(words(k, 200, 30)).replace("w", "wordy ") + " colour color colouur", "s")
            for k in range(120)]
    got = S.spelling_forms(S.word_counts(documents(spark, rows)))
    assert as_rows(got) == slow_forms(slow_words(rows))


# Piece coding

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def coder(library):
    return C.PieceCoder(library)


def odd_texts(library, seed, n):
    rng = random.Random(seed)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    makers = [
        lambda k: "".join(rng.choice(pieces) for _ in range(k)),
        lambda k: "".join(rng.choice("abcdeht in ") for _ in range(k)),
        lambda k: "".join(rng.choice(" ▁ \n\ta") for _ in range(k)),
        lambda k: "".join(chr(rng.choice([rng.randrange(0, 0x250), rng.randrange(0x3000, 0xA000),
                                          0x1F600, 0xFFFD])) for _ in range(k)),
        lambda k: rng.choice("ab x=*-#") * k * 3 + rng.choice(pieces),
        lambda k: " ".join(rng.choice(pieces)[::-1] for _ in range(k))]
    return [rng.choice(makers)(rng.randrange(60)) for _ in range(n)]


@pytest.mark.parametrize("block", [1 << 18, 50])
def test_ids_equal_the_library(library, coder, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    texts = ["", " ", "  ", "<s>x</s>", "<0x41>"] + odd_texts(library, block, 1500)
    flat, counts = coder.encode(texts)
    ends = np.cumsum(counts)
    for text, start, end in zip(texts, ends - counts, ends):
        assert flat[start:end].tolist() == library.encode(text), repr(text)
        assert coder.decode(flat[start:end]) == library.decode(library.encode(text)), repr(text)


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(C, "MOST_WORDS", 20)
    monkeypatch.setattr(C, "BLOCK", 100)
    texts = odd_texts(library, 3, 300)
    flat, _ = C.PieceCoder(library).encode(texts)
    assert flat.tolist() == [i for t in texts for i in library.encode(t)]


def test_merges_in_strict_order_agree(coder, library):
    for text in filter(None, odd_texts(library, 4, 300)):
        symbols = coder._symbols_of(["▁" + text.replace(" ", "▁")])
        ids, _ = coder._ids_of(np.array(coder._one_by_one(symbols.tolist()), np.int64))
        assert ids.tolist() == library.encode(text)


def test_any_ids_decode_like_the_library(library, coder):
    rng = random.Random(6)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(0, 262), 28705, 259, 260])
               for _ in range(rng.randrange(8))]
        assert coder.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_round_trip_of_awkward_rows(spark, library):
    rows = awkward() + [(700, " " * 30_000 + "end", "c"), (701, "qz" * 20_000, "c")]
    docs = documents(spark, rows)
    both = C.decoded(C.encoded(docs))
    assert both.columns == [*[c for c in docs.columns if c != "text"], "ids", "decoded"]
    got = sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in collect(both))
    ids = [(i, library.encode(t or "")) for i, t, _ in rows]
    assert got == sorted((str(i), x, library.decode(x)) for i, x in ids)
    assert collect(C.decoded(C.encoded(docs.limit(0)))) == []


def test_null_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert sorted((r["k"], r["decoded"]) for r in collect(C.decoded(rows))) == [(1, ""), (2, "")]


def test_registered_round_trip(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in collect(
        queries.QUERIES["op12_piece_round_trip"](spark, "/root/testdata/sf0.001"))}
    want = {}
    for r in docs:
        ids = library.encode(r["text"] or "")
        want[r["doc_id"]] = (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert got == want


def test_registered_forms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = queries.QUERIES["op13_spelling_forms"](spark, "/root/testdata/sf0.001")
    counts = slow_words([(r["doc_id"], r["text"], None) for r in docs])
    # Pairs from deleting each letter, which brute force on so many words needs.
    groups = {}
    for w in counts:
        for v in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            groups.setdefault(v, []).append(w)
    others = {w: set() for w in counts}
    for group in groups.values():
        for a, b in itertools.combinations(group, 2):
            if near(a, b):
                others[a].add(b)
                others[b].add(a)
    want = {}
    for w, n in counts.items():
        best = min(others[w], key=lambda x: (-counts[x], x.encode()), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        want[w] = (form, n, len(others[w]), counts.get(form))
    rows = {r["word"]: r for r in collect(got)}
    assert {w: (r["form"], r["n"], r["n_near"], r["form_n"]) for w, r in rows.items()} == want
    for w, r in rows.items():
        top = w
        while want[top][0]:
            top = want[top][0]
        assert r["root"] == top
