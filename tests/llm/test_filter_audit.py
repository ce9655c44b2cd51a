import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa

from lattica.llm import filter_audit as fa

DOCS, LABELS = "doc_id long, lang string, text string, mask int", "doc_id long, quality int, toxic int, good boolean"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fails(doc, docs):
    i, _, text, _ = doc
    text = text or ""
    w = words_of(text)
    caps = sum("A" <= c <= "Z" for c in text)
    copy = i is not None and any(j is not None and j < i and (t or "") == text for j, _, t, _ in docs)
    return "".join(x for x, bad in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * caps > 3 * len(text), re.search(r"[#$%&*|]", text), copy]) if bad)


def brute_audit(docs, labels):
    bad = [fails(d, docs) for d in docs]
    good, toxic = {i for i, q, _, _ in labels if q == 1 and i is not None}, {i for i, _, t, _ in labels if t == 1 and i is not None}
    rows, shares = [], {}
    for part in {d[1] or "" for d in docs}:
        own = [(d, b) for d, b in zip(docs, bad) if (d[1] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(d, b) for d, b in left if x in b]
                left = [(d, b) for d, b in left if x not in b]
                shares[part, x] = shares.get((part, x), 0) + len(gone)
                redundant = sum(x in b for _, b in own) - len(gone)
                rows.append([part, order, step, len(left), len(gone), redundant, sum(b == x for _, b in own), sum(d[0] in good for d, _ in gone), sum(d[0] in toxic for d, _ in gone)])
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in rows)


def texts(rng):
    out = [None, "", " \n", "a", "é ß", "a\x0bb\x0cc d e", "#", "A" * 5, "x" * 300_000, ("w " * 150_000)[:-1], "AB " * 250]
    out += [" ".join(rng.choices([f"v{k}é" for k in range(rng.choice([50, 300, 3000]))], k=rng.randrange(400))) for _ in range(60)]
    out += [rng.choice(["#", "|", "É", ""]) + " ".join(f"{rng.choice('abX')}{k}" for k in range(rng.randrange(150, 260))) for _ in range(30)]
    return out


def test_counts_of_buffers():
    rng = random.Random(2)
    given = texts(rng)
    for array in (pa.array(given), pa.array(given, pa.large_string()), pa.array(["skip me", *given, "x"]).slice(1, len(given)), pa.array([], pa.string()), pa.array([None], pa.string())):
        got = fa.text_counts(array)
        for k, t in enumerate(array.to_pylist()):
            t, w = t or "", words_of(t)
            want = len(w), len(set(w)), sum("A" <= c <= "Z" for c in t), sum(c in "#$%&*|" for c in t), len(t)
            assert tuple(int(got[c][k]) for c in ("words", "distinct", "capitals", "symbols", "chars")) == want


def test_equal_hashes_are_verified():
    """With hashes that say nothing, or the length alone, distinct words are still right."""
    rng = random.Random(3)
    array = pa.array(texts(rng)[:8] + [" ".join(rng.choices("abcdefgh", k=30)) + " aa ab" for _ in range(40)])
    want = [len(set(words_of(t))) for t in array.to_pylist()]
    for hashed in (lambda d, b, e: np.zeros(len(b), np.uint64), lambda d, b, e: (e - b).astype(np.uint64), lambda d, b, e: fa.word_hashes(d, b, e) & np.uint64(3)):
        assert fa.text_counts(array, hashed)["distinct"].tolist() == want


def test_hashes_do_not_depend_on_runs(monkeypatch):
    data = np.frombuffer(b"one two  one\nthree two " * 50, np.uint8)
    word = np.concatenate([[False], ~fa._IS_SPACE[data], [False]])
    edges = np.flatnonzero(np.diff(word))
    begins, ends = edges[::2], edges[1::2]
    want = fa.word_hashes(data, begins, ends)
    for run in (1, 4, 64):
        monkeypatch.setattr(fa, "RUN_BYTES", run)
        assert (fa.word_hashes(data, begins, ends) == want).all()
    names = [bytes(data[a:z]) for a, z in zip(begins, ends)]
    assert len(set(zip(names, want.tolist()))) == len(set(names)) == len(set(want.tolist())) == 3


def test_audit_against_brute_force(spark):
    rng = random.Random(4)
    pool = texts(rng)
    docs = [(k, rng.choice(["de", "en", None, ""]), rng.choice(pool), 7) for k in range(150)]
    docs += [docs[0], docs[3], (None, "en", "copy", 1), (None, "en", "copy", 1), (400, "de", "copy", 1), (401, None, "copy", 1), (402, "fr", "copy", 1), (402, "fr", "copy", 1)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1]), True) for k in range(0, 420, 2)] + [(2, 1, 1, True), (None, 1, 1, True)]
    masks = fa.failure_masks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert sorted(tuple(r) for r in fa.audit(masks).collect()) == brute_audit(docs, labels)
    nothing = fa.failure_masks(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert fa.audit(nothing).count() == 0
