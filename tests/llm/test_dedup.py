import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from lattica.llm import lattice, repeats, simhash

DOC = "doc_id long, text string"


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return [least[find(k)] for k in range(len(ids))]


def some_texts(seed=1, n=120):
    rng = random.Random(seed)
    words = [f"W{k}" for k in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(n)]
    out = list(base)
    for text in base[: n // 2]:
        parts = text.split()
        parts[rng.randrange(len(parts))] = "changed"
        out += ["\t".join(parts), text.lower()]
    return out + [None, "", " \n", "É é", "x" * 50_000, "a b " * 5_000]


def test_simhash_against_brute_force(spark):
    texts = some_texts()
    rows = [(k, t) for k, t in enumerate(texts)]
    random.Random(2).shuffle(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_dedup(spark.createDataFrame(rows, DOC).repartition(3)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    want = components(list(range(len(fps))), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 3)
    assert got == {k: (f"{fps[k]:016x}", want[k]) for k in range(len(fps))}


def test_large_buckets_are_dealt_again_without_losing_links(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 300:
        fp = rng.choice(sorted(fps))
        for b in rng.sample(range(64), rng.randint(1, 5)):
            fp ^= 1 << b
        fps.add(fp)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "id long, fp long")
    from lattica.llm.common import connected_components

    got = {r.id: r.component for r in connected_components(simhash.near_links(nodes, bucket_rows=20)).collect()}
    want = components(list(range(300)), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 3)
    assert [got.get(k, k) for k in range(300)] == want


def test_simhash_edge_cases(spark):
    assert simhash.near_dedup(spark.createDataFrame([], DOC)).count() == 0
    rows = [(None, "a b c"), (5, "a b c"), (5, "a b c"), (9, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], DOC + ", fp string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in simhash.near_dedup(df).collect())
    assert got == [(-1, 5, False), (5, 5, True), (5, 5, True), (9, 9, True)] or got[1:] == [(5, 5, True), (5, 5, True), (9, 9, True)]


def brute_repeats(docs, window):
    first = {}
    words = [(t or "").encode().split() for _, t in docs]
    for (i, _), w in zip(docs, words):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(docs, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


@pytest.mark.parametrize("window,batch", [(13, 400), (13, 1 << 20), (30, 900), (5, 700), (2, 500), (1, 300)])
def test_repeats_against_brute_force(spark, monkeypatch, window, batch):
    rng = random.Random(window)
    passages = [" ".join(rng.choices("abcdefgh", k=rng.randint(8, 60))) for _ in range(6)]
    docs = []
    for k in range(60):
        parts = [" ".join(rng.choices([f"w{j}" for j in range(300)], k=rng.randint(0, 20))) for _ in range(3)]
        docs.append((rng.randrange(40), "\n ".join([parts[0], rng.choice(passages), parts[1], rng.choice(passages), parts[2]])))
    docs += [(100, None), (101, ""), (102, " \t"), (103, docs[0][1]), (7, docs[0][1])]
    monkeypatch.setattr(repeats, "BATCH_BYTES", batch)
    monkeypatch.setattr(repeats, "PART_BYTES", batch)
    out = repeats.remove_repeats(spark.createDataFrame(docs, DOC), window).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out) == brute_repeats(docs, window)


def test_repeats_edge_cases(spark):
    assert [repeats.levels(n) for n in (13, 50, 2, 1)] == [[7, 13], [7, 13, 25, 50], [1, 2], [1]]
    often = spark.createDataFrame([(None, "")] * 50 + [(None, " ".join(map(str, range(20))))] * 50 + [(1, " ".join(map(str, range(20))))], DOC).repartition(4)
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in repeats.remove_repeats(often).collect()) == [(0, 0, 0)] * 50 + [(0, 20, 20)] * 50 + [(1, 20, 0)]
    assert repeats.remove_repeats(spark.createDataFrame([], DOC)).count() == 0
    long = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(None, long, 1), (3, long, 2)], DOC + ", n_words int")
    got = {r.doc_id: (r.n_removed, r.n_words) for r in repeats.remove_repeats(df).collect()}
    assert got == {3: (0, 30), None: (30, 30)}


def cosine_links(vectors):
    x = np.array([v / np.linalg.norm(v) for v in vectors])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    return near


def test_lattice_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 2
    points = lattice.decode_e8(x)
    around = lattice.least_vectors()
    assert len(around) == 240 and np.allclose((around**2).sum(1), 2)
    best = ((x - points) ** 2).sum(1)
    for v in around:
        assert (best <= ((x - points - v) ** 2).sum(1) + 1e-9).all()


@pytest.mark.parametrize("cell_rows", [4096, 40])
def test_near_vectors_against_brute_force(spark, cell_rows):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 64))
    near = [b + rng.normal(size=64) * s for b, s in zip(base[:100], np.linspace(0.02, 0.5, 100))]
    hub = [base[0] + rng.normal(size=64) * 0.03 for _ in range(120)]
    vectors = np.array([*base, *near, *hub, base[3], base[3]], np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 64, [nan] * 64, [inf] * 64, [None] * 64, [1.0, 2.0]]
    rows += [(1000 + k, v) for k, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_vectors(df, cell_rows=cell_rows).collect()}
    links = cosine_links(vectors.astype(float))
    found = sum(got[k][0] for k in range(len(vectors)))
    assert all(got[k][0] <= links[k].sum() for k in range(len(vectors)))
    assert found >= 0.98 * links.sum()
    assert all(got[1000 + k] == (0, 1000 + k) for k in range(len(odd)))
    if found == links.sum():
        assert [got[k][1] for k in range(len(vectors))] == components(list(range(len(vectors))), lambda a, b: links[a, b])


def test_recall_and_cells_of_every_setting():
    """Pairs at cosine 0.9 exactly, the hardest that count, meet with a chance of 0.99; a setting for more vectors has more cells."""
    rng = np.random.default_rng(5)
    u = rng.normal(size=(3000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    cells = []
    for _, setting in lattice.SETTINGS:
        a, b = (setting.keys(x) for x in (u, 0.9 * u + np.sqrt(0.19) * w))
        meet = (a[:, :, :1] == b).any((1, 2)) | (b[:, :, :1] == a).any((1, 2))
        assert meet.mean() > 0.99
        shared = sum((c * (c - 1)).sum() for t in range(setting.tables) for c in [np.unique(a[:, t, 0], return_counts=True)[1]]) / setting.tables
        cells.append(len(u) ** 2 / max(shared, 1e-9))
    assert cells[0] > 200 and all(y > 4 * x for x, y in zip(cells, cells[1:]))
    assert [lattice.lattice_for(n).codes for n in (10, 10**6, 10**7, 10**8, 10**9)] == [1, 1, 2, 2, 3]


@pytest.mark.parametrize("dim", [8, 16, 128, 768])
def test_recall_in_other_dimensions(dim):
    """Pairs at cosine 0.9, of vectors in 20 clusters, in every setting."""
    rng = np.random.default_rng(dim)
    u = rng.normal(size=(20, dim))[rng.integers(0, 20, 1500)] + 0.5 * rng.normal(size=(1500, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    for _, setting in lattice.SETTINGS:
        a, b = (setting.keys(x) for x in (u, 0.9 * u + np.sqrt(0.19) * w))
        assert ((a[:, :, :1] == b).any((1, 2)) | (b[:, :, :1] == a).any((1, 2))).mean() > 0.985


def test_finer_settings_give_the_same_links(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 64))
    vectors = np.concatenate([base, base + rng.normal(size=base.shape) * 0.2])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    want = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_vectors(df).collect()}
    assert sum(n for n, _ in want.values()) >= 120
    for setting in (lattice.SETTINGS[1][1], lattice.SETTINGS[3][1]):
        assert {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_vectors(df, lattice=setting).collect()} == want


def test_near_vectors_empty(spark):
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_digest_of_the_query(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(20))
    spark.createDataFrame([(1, text), (2, "x " + text), (3, None)], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.op8_substring_dedup(spark, str(tmp_path)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (20, 0, digest(text)), 2: (21, 20, digest("x")), 3: (0, 0, digest(""))}


def test_links_do_not_depend_on_how_many_vectors_there_are(spark, monkeypatch):
    """The same pairs are linked whatever lattice would suit their number."""
    rng = np.random.default_rng(31)
    base = rng.normal(size=(150, 64))
    m = np.vstack([base, base + 0.4 * rng.normal(size=base.shape)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id long, embedding array<double>")
    links = lambda: sorted((r.vec_id, r.n_links) for r in lattice.near_vectors(df).collect())
    want = links()
    monkeypatch.setattr(lattice, "SETTINGS", ((10, lattice.Lattice()), (None, lattice.Lattice(tables=1, probes=0))))
    assert links() == want
