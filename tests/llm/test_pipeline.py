import hashlib
import math
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import bpe, mixing, simhash_wide
from tests.llm.test_dedup import brute_repeats
from tests.llm.test_filters import brute_rejects

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    passage = " ".join(fresh(60))
    texts = [" ".join(fresh(rng.randint(60, 400))) for _ in range(60)]
    originals = list(range(20))
    copies = {}
    for k in originals:
        parts = texts[k].split()
        if k % 2:
            parts[rng.randrange(len(parts))] = "changed"
        copies[len(texts)] = k
        texts.append(" ".join(parts))
    shared = []
    for _ in range(6):
        shared.append(len(texts))
        texts.append(" ".join([*fresh(100), passage, *fresh(100)]))
    junk = [None, "", "too short", "### " * 100, "same words here " * 100, "\n".join(["one line of text that is long enough"] * 20)]
    texts += junk
    rows = [(k, t, "en", f"s{k % 4}" if k % 17 else None, len(t or "")) for k, t in enumerate(texts)]
    return rows, copies, shared


def test_stages_against_brute_force(spark):
    rows, copies, shared = corpus()
    docs = spark.createDataFrame(rows, DOCUMENTS + "").repartition(3)
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality_rules"](spark, docs, "")
    assert kept.columns == docs.columns
    kept_rows = {r.doc_id: r for r in kept.collect()}
    for k, text, *_ in rows:
        assert (k in kept_rows) == (not brute_rejects(text)), k

    near = stages["simhash_near_dedup"](spark, kept, "")
    near_ids = {r.doc_id for r in near.collect()}
    assert near.columns == docs.columns
    assert near_ids == set(kept_rows) - set(copies)

    cut = stages["substring_dedup"](spark, near, "")
    want = {i: (n, removed, text) for i, n, removed, text in brute_repeats([(i, kept_rows[i].text) for i in sorted(near_ids)], 13)}
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns and set(got) == set(want)
    for i, (n, removed, text) in want.items():
        assert got[i].text == (text if removed else kept_rows[i].text) and got[i].n_chars == len(got[i].text)
    assert all(want[i][1] >= 60 for i in shared[1:]) and want[shared[0]][1] == 0

    mixed = stages["mix_sources"](spark, cut, "")
    assert mixed.columns == docs.columns
    times = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = {r.doc_id: r.copies for r in mixing.mix(cut).collect()}
    assert times == {i: n for i, n in taken.items() if n}

    out = stages["encode_tokens"](spark, mixed, "").collect()
    tokens = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    assert len(out) == sum(times.values())
    for r in out:
        assert r.token_ids == library.encode_ordinary(got[r.doc_id].text)
        assert r.decoded_sha256 == hashlib.sha256(got[r.doc_id].text.encode()).hexdigest()


def test_run_equals_the_stages_and_takes_empty_tables(spark, tmp_path):
    rows, _, _ = corpus(2)
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/a/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, f"{tmp_path}/a")
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert key(corpus_pipeline.run(spark, f"{tmp_path}/a")) == key(docs)
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_similar_dedup(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(4000)]
    base = [[rng.choice(words) for _ in range(250)] for _ in range(150)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    near = []
    for k in range(100):
        w = list(base[k])
        for at in rng.sample(range(250), 2):
            w[at] = "edited"
        near.append(1000 + k)
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000 + k, rows[0][1]) for k in range(30)] + [(3000, None), (3001, ""), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bucket in (4096, 10):
        got = {r.doc_id: r for r in simhash_wide.similar_dedup(df, bucket_rows=bucket).collect()}
        assert all(got[k].kept for k in range(150))
        caught = sum(got[k].component_id == k - 1000 for k in near)
        assert caught >= 97
        assert all(got[2000 + k].component_id == 0 for k in range(30)) and got[3001].component_id == 3000
    assert simhash_wide.similar_dedup(df.limit(0)).count() == 0


def pair_at(rng, words, n, share, base=None):
    """Two texts of n words of which the second has a share of its 5-word shingles with the first, by one changed end."""
    first = base or [rng.choice(words) for _ in range(n)]
    kept = round(2 * share / (1 + share) * (n - 4)) + 4
    return first, first[:kept] + [rng.choice(words) for _ in range(n - kept)]


def jaccard(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_documents_below_the_similarity_stay(spark):
    """No text goes that is below 0.8 to all others, neither in pairs nor in a family around one text."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(4000)]
    rows = []
    for k in range(150):
        a, b = pair_at(rng, words, 250, (0.6, 0.7, 0.78)[k % 3])
        assert 0.5 < jaccard(a, b) < 0.8
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    centre = [rng.choice(words) for _ in range(250)]
    rows += [(1000 + k, " ".join(pair_at(rng, words, 250, 0.75, centre)[1])) for k in range(40)]
    got = simhash_wide.similar_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.kept for r in got) and len(got) == len(rows)


def test_recall_at_the_similarity(spark):
    """Pairs just at 0.8, the hardest that count, are found, of long and of short texts."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(4000)]
    rows = []
    for k in range(400):
        a, b = pair_at(rng, words, (14, 40, 120, 300)[k % 4], 0.815)
        assert 0.8 <= jaccard(a, b) < 0.85
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bucket in (4096, 10):
        got = {r.doc_id: r.component_id for r in simhash_wide.similar_dedup(df, bucket_rows=bucket).collect()}
        assert sum(got[2 * k + 1] == 2 * k for k in range(400)) >= 392


def test_chained_candidates_are_dealt_to_buckets(spark):
    """A chain of texts, each near the next one but not similar enough: twice the texts are dealt twice as often."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(16_000)]
    dealt = []
    for n in (300, 600):
        docs = spark.createDataFrame([(k, " ".join(words[18 * k : 18 * k + 120])) for k in range(n)], "doc_id long, text string")
        nodes = simhash_wide.fingerprints(docs).withColumnRenamed("doc_id", "id")
        members = nodes.withColumn("component", F.lit(0).cast("long"))
        times = lambda split: simhash_wide.dealt(members, block_rows=10, split=split).select(F.explode("places.k").alias("k")).agg(F.sum("k")).first()[0]
        dealt.append((times(1), times(10**6)))
        assert simhash_wide.similar_dedup(docs).where("NOT kept").count() == 0
    (buckets, pairs), (more_buckets, more_pairs) = dealt
    assert more_buckets < 2.3 * buckets and more_pairs > 3.5 * pairs and more_buckets < more_pairs


@pytest.mark.parametrize("split", [16, 1])
def test_large_components_are_dealt_in_blocks(spark, split):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    centre = [rng.choice(words) for _ in range(120)]
    rows = [(k, " ".join(pair_at(rng, words, 120, 0.93, centre)[1])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = simhash_wide.fingerprints(docs).withColumnRenamed("doc_id", "id")
    together = nodes.select("id", F.lit(0).cast("long").alias("component"))
    links = simhash_wide.verified_links(docs, nodes, together, 128, block_rows=15, split=split).collect()
    sets = [t.split() for _, t in rows]
    root = list(range(60))
    for a in range(60):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.8:
                root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    found = list(range(60))
    for r in links:
        found = [min(found[r.a], found[r.b]) if x in (found[r.a], found[r.b]) else x for x in found]
    assert found == root


def test_mix_meets_its_targets(spark):
    rng = random.Random(5)
    rows = [(k, f"s{min(int(rng.expovariate(0.5)), 7)}" if k % 50 else None, " ".join(["x"] * int(rng.paretovariate(1.2) * 20))) for k in range(3000)]
    rows += [(4000, "zero", ""), (4001, "zero", None), (5, "s1", "repeated row")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df).collect()
    size, taken, target = {}, {}, {}
    for r in got:
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 2 * r.size
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(size.values()), set()
    while True:
        unit = (total - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and weight[s] * unit > 2 * size[s]}
        if not more:
            break
        capped |= more
    for s in names:
        want = 2 * size[s] if s in capped else weight[s] * unit
        assert abs(target[s] - want) <= 1e-6 * max(want, 1)
        assert abs(taken[s] - want) <= 0.02 * want + 60
    again = sorted((r.doc_id, r.taken) for r in mixing.mix(df.repartition(5)).collect())
    assert again == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def brute_mix(rows, cap=2.0):
    """Copies of ``(source, chunk, place, size, target)``: multipliers by bisection, then words carried over chunk by chunk."""
    prior = lambda n: max(1.25 - 0.15 * abs(math.floor(math.log2(max(n, 1))) - 8), 0.5)
    rate = lambda n, m: cap / (1 + (cap / prior(n) - 1) * math.exp(-m))
    by_source = {}
    for r in rows:
        by_source.setdefault(r[0], []).append(r)
    copies = {}
    for source, own in by_source.items():
        total, target = sum(r[3] for r in own), own[0][4]
        low, high = -40.0, 40.0
        for _ in range(200):
            m = (low + high) / 2
            low, high = (m, high) if sum(r[3] * rate(r[3], m) for r in own) < target else (low, m)
        for chunk in {r[1] for r in own}:
            over = 0.0
            for _, _, place, n, _ in sorted((r for r in own if r[1] == chunk), key=lambda r: (-r[3], r[2])):
                due = (cap if target >= cap * total else rate(n, m)) * n + over
                fits = [c for c in range(int(cap) + 1) if abs(c - (due - over) / max(n, 1)) < 1 - 1e-6]
                copies[source, chunk, place] = min(fits, key=lambda c: abs(due - c * n)) if n else 0
                over = due - copies[source, chunk, place] * n
    return copies


def test_taken_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 64)
    rng = random.Random(6)
    rows = [(k, f"s{min(int(rng.expovariate(0.5)), 5)}", " ".join(["x"] * int(rng.paretovariate(1.1) * 15))) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df).withColumns({"hash": F.xxhash64("text"), "place": F.xxhash64("doc_id")}).collect()
    count = {}
    for r in got:
        count[r.source] = count.get(r.source, 0) + 1
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id", F.xxhash64("text")).alias("h")).collect()}
    chunk = {r.doc_id: hashes[r.doc_id] % math.ceil(count[r.source] / 64) for r in got}
    want = brute_mix([(r.source, chunk[r.doc_id], r.place, r.size, r.target) for r in got])
    assert {r.doc_id: r.copies for r in got if r.size} == {r.doc_id: want[r.source, chunk[r.doc_id], r.place] for r in got if r.size}
    assert len({round(r.rate, 6) for r in got if r.source == "s1"}) > 4  # the tilt, not one rate a source
    few = sorted((r.doc_id, r.copies) for r in got)
    monkeypatch.setattr(mixing, "FEW", 0)
    assert sorted((r.doc_id, r.copies) for r in mixing.mix(df).collect()) == few


def test_tilt_that_does_not_converge_is_an_error(spark):
    strata = spark.createDataFrame([("a", 0.001, 1000), ("a", 1.9, 10)], "source string, prior double, words long")
    targets = spark.createDataFrame([("a", 1010, 1900.0)], "source string, words long, target double")
    assert mixing.tilted(strata, targets).count() == 1
    with pytest.raises(RuntimeError, match="did not converge"):
        mixing.tilted(strata, targets, most=2)


def test_tilt_follows_the_prior(spark):
    """Newton on strata of unlike priors meets the target and keeps the odds ratio of any two priors."""
    strata = spark.createDataFrame([("a", 1.0, 1000), ("a", 0.5, 3000), ("b", 1.0, 10)], "source string, prior double, words long")
    targets = spark.createDataFrame([("a", 4000, 3000.0), ("b", 10, 20.0)], "source string, words long, target double")
    m = {r.source: r.m for r in mixing.tilted(strata, targets).collect()}
    rates = {r.prior: r.rate for r in strata.where("source = 'a'").withColumn("rate", mixing.rate_of(F.col("prior"), F.lit(m["a"]))).collect()}
    assert abs(1000 * rates[1.0] + 3000 * rates[0.5] - 3000) < 1e-3 and m["b"] == float("inf")
    odds = {p: (r / 2) / (1 - r / 2) for p, r in rates.items()}
    assert abs(odds[1.0] / odds[0.5] - (0.5 / 0.5) / (0.25 / 0.75)) < 1e-6
