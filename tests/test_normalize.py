import json
import random
import re

import pytest

from lattica.functions.similarity import indel_ratio, lcs_length, list_similarity, normal
from lattica.operators import header_index, normalize
from lattica.operators.header_index import met_strings, similar_lists, similar_strings

STEMS = ["Fecha", "Estado", "Responsable", "Acuerdo", "Riesgo", "Id", "Monto total", "Area", "fecha limite", ""]
SCHEMAS = "schema_ord int, schema_id string, canonical_columns array<string>, column_mapping map<string,string>"


def edit(rng, s):
    return "".join(rng.choice(["", c, c, c, c, c, c + rng.choice("aeo")]) for c in s)


def strings(spark, values):
    return spark.createDataFrame([(v,) for v in values], "s string")


def random_headers(rng, n):
    parts = "the an in er on or re at en ti ed nd ha es st ou ing ion sh th bl wh qu ka zi pro mer dat nam sta res com pre kl br gu fe ix oz jo".split()
    return sorted({" ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.choice([1, 1, 2, 2, 3])))[:24] for _ in range(n)})


def test_ratio():
    assert (lcs_length("acuedo", "acuerdo"), lcs_length("", "a"), lcs_length("abcbdab", "bdcaba")) == (6, 0, 4) and indel_ratio("", "") == 1.0


@pytest.mark.parametrize("at_least", [0.75, 0.6])
def test_similar_strings_meet(spark, at_least):
    """All pairs of the ratio are found, and of unlike strings hardly one in a hundred is compared."""
    rng = random.Random(1)
    left = random_headers(rng, 700)
    right = sorted({edit(rng, s) for s in left[:300]} | set(random_headers(rng, 400)))
    got = {tuple(r) for r in similar_strings(strings(spark, left + [""]), strings(spark, right + [""]), at_least).collect()}
    want = {(x, y) for x in left + [""] for y in set(right + [""]) if indel_ratio(x, y) >= at_least - 1e-9}
    assert got == want and len(want) > 200
    if at_least == 0.75:
        met = met_strings(strings(spark, left), strings(spark, left), at_least).where("x < y").count()
        assert met < 0.01 * len(left) * (len(left) - 1) / 2


def test_similar_strings_of_any_length(spark):
    rng = random.Random(2)
    some = ["a" * n for n in (1, 2, 3, 4, 30, 100, 127, 128, 129, 150, 300, 1000)] + ["ab" * 40, "ab" * 70, "ba" * 70, "é漢" * 3, "漢é" * 3]
    some += [("".join(rng.choices("abcdef", k=n))) for n in (5, 60, 120, 130, 140, 200)]
    some += [edit(rng, s) for s in some if len(s) > 3]
    some = sorted(set(some))
    got = {tuple(r) for r in similar_strings(strings(spark, some), strings(spark, some), 0.75).collect()}
    assert got == {(x, y) for x in some for y in some if indel_ratio(x, y) >= 0.75 - 1e-9}
    assert similar_strings(strings(spark, []), strings(spark, some), 0.75).count() == 0


@pytest.mark.parametrize("common", [1000, 5])
def test_similar_lists_against_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(header_index, "COMMON", common)
    rng = random.Random(common)
    lists = [(k, [normal(edit(rng, rng.choice(STEMS))) if rng.random() < 0.5 else normal(rng.choice(STEMS)) for _ in range(rng.randint(0, 9))]) for k in range(150)]
    left, right = spark.createDataFrame(lists, "a int, ha array<string>"), spark.createDataFrame(lists, "b int, hb array<string>")
    got = [(r.a, r.b, round(r.score, 9)) for r in similar_lists(left, right, 0.75).collect()]
    want = {(a, b, round(list_similarity(x, y), 9)) for a, x in lists for b, y in lists if list_similarity(x, y) >= 0.75 - 1e-12}
    assert len(got) == len(set(got)) and set(got) == want


def test_similar_tables_and_best_match_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, [edit(rng, rng.choice(STEMS)) if rng.random() < 0.6 else rng.choice(STEMS) for _ in range(rng.randint(0, 4))]) for k in range(120)]
    tables = spark.createDataFrame(rows, "ord int, headers array<string>")
    first = {}
    for k, h in rows:
        first.setdefault(tuple(h), k)
    kinds = [(k, [normal(x) for x in h]) for h, k in first.items()]
    want = {(a, b) for a, x in kinds for b, y in kinds if a < b and list_similarity(x, y) >= 0.75 - 1e-12} | {(first[tuple(h)], k) for k, h in rows if first[tuple(h)] != k}
    got = [(r.a, r.b) for r in normalize.similar_tables(tables).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    label = {k: k for k, _ in rows}
    for _ in rows:
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.ord: r.cluster for r in normalize.clusters(tables).collect()} == label
    some = [(n, f"s{n}", [x for x in h if x][:2], {x: x for x in set(h[2:])}) for n, (_, h) in enumerate(rows[:40])]
    schemas = spark.createDataFrame(some, SCHEMAS)
    names = [[normal(x) for x in [*c, *m]] for _, _, c, m in some]
    for lists, block in ((4096, 20_000), (10, 7)):
        monkeypatch.setattr(normalize, "BLOCK_LISTS", lists)
        monkeypatch.setattr(normalize, "BLOCK_NAMES", block)
        best = {r.ord: (r.schema_id, round(r.score, 9)) for r in normalize.best_match(tables, schemas).collect()}
        for k, h in rows:
            scores = [list_similarity([normal(x) for x in h], n) for n in names]
            assert best.get(k) == ((f"s{scores.index(max(scores))}", round(max(scores), 9)) if max(scores) > 0 else None)


def test_classify_takes_off_fences(spark):
    df = spark.createDataFrame([(0, [["A"]], ["A"], 2)], "cluster int, variants array<array<string>>, sample array<string>, tables int")
    got = normalize.classify(df, lambda prompt: '```json\n[{"table_type": "t"}, {"canonical_columns": ["a"]}]\n```').collect()
    assert [tuple(r) for r in got] == [(0, 0, "t", [], {}), (0, 1, None, ["a"], {})]
    with pytest.raises(Exception, match="JSON"):
        normalize.classify(df, lambda prompt: "no answer").collect()


def namer(prompt):
    """A schema with other names than the headers', which so fits other tables as well; none for lists with an id."""
    sample = json.loads(prompt)["sample"]
    if any(normal(h) == "id" for h in sample):
        return "[]"
    plain = [re.sub(r"\W", "_", normal(h)) or "blank" for h in sample]
    return json.dumps([{"table_type": "_".join(plain), "canonical_columns": plain + ["estado"], "column_mapping": dict(zip(sample, plain))}, {"table_type": "second"}])


def routed_one_by_one(rows, schemas):
    """The loop: each table meets the schemas that are there; a list of headers names one schema at most."""
    known = [(i, [normal(x) for x in [*c, *m]]) for _, i, c, m in schemas]
    out, made, asked = {}, [], set()
    for k, headers, cols, size in rows:
        own = [normal(h) for h in headers]
        scores = [list_similarity(own, names) for _, names in known]
        top = max(scores, default=0.0)
        if top >= 0.7 - 1e-12:
            out[k] = ("assigned", known[scores.index(top)][0], round(top, 3))
            continue
        answer = json.loads(namer(json.dumps({"sample": headers}))) if cols >= 2 and size >= 2 and tuple(headers) not in asked else []
        if cols >= 2 and size >= 2:
            asked.add(tuple(headers))
        if answer:
            s = answer[0]
            known.append((f"schema_{k}", [normal(x) for x in [*s["canonical_columns"], *s["column_mapping"], *headers]]))
            made.append((f"schema_{k}", s["table_type"], k))
            out[k] = ("new", f"schema_{k}", 0.0)
        else:
            out[k] = ("unknown", None, round(top, 3))
    return out, made


@pytest.mark.parametrize("seed", [1])
def test_routes_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(160):
        headers = rng.choice(rows)[1] if rows and rng.random() < 0.3 else [edit(rng, rng.choice(STEMS)) if rng.random() < 0.5 else rng.choice(STEMS) for _ in range(rng.randint(0, 4))]
        rows.append((k, headers, len(headers), rng.choice([1, 2, 5])))
    schemas = [(0, "given", ["fecha", "estado"], {"Fecha": "fecha"}), (1, "other", ["monto"], {})]
    routes, added = normalize.route(spark.createDataFrame(rows, "ord int, headers array<string>, col_count int, row_count int").repartition(3), spark.createDataFrame(schemas, SCHEMAS), namer)
    want, made = routed_one_by_one(rows, schemas)
    got = {r.ord: (r.route, r.schema_id, r.score) for r in routes.collect()}
    assert {k: r[:2] for k, r in got.items()} == {k: r[:2] for k, r in want.items()}
    assert all(abs(got[k][2] - r[2]) < 0.0011 for k, r in want.items())  # a half may be rounded either way
    assert [(r.schema_ord, r.schema_id, r.table_type, r.since) for r in added.orderBy("schema_ord").collect()] == [(2 + n, *m) for n, m in enumerate(made)]
    assert len(made) > 10 and {r for r, _, _ in want.values()} == {"assigned", "new", "unknown"}


def test_routes_without_a_model_or_schemas(spark):
    tables = spark.createDataFrame([(0, ["a", "b"], 2, 2), (1, ["a", "b"], 2, 1)], "ord int, headers array<string>, col_count int, row_count int")
    none = spark.createDataFrame([], SCHEMAS)
    routes, added = normalize.route(tables, none)
    assert [(r.ord, r.route, r.schema_id, r.score) for r in routes.orderBy("ord").collect()] == [(0, "new", None, 0.0), (1, "unknown", None, 0.0)] and added.count() == 0
    routes, added = normalize.route(tables, none, namer)
    assert [(r.ord, r.route, r.schema_id) for r in routes.orderBy("ord").collect()] == [(0, "new", "schema_0"), (1, "assigned", "schema_0")] and added.count() == 1
    assert normalize.route(tables.limit(0), none, namer)[0].count() == 0


def test_variants_of_a_cluster_are_bounded(spark):
    tables = spark.createDataFrame([(k, [f"h{k % 7}"]) for k in range(30)], "ord int, headers array<string>")
    row = normalize.cluster_summaries(tables, tables.selectExpr("ord", "0 AS cluster"), most=3).first()
    assert (row.tables, row["sample"], row.variants) == (30, ["h0"], [["h0"], ["h1"], ["h2"]])
