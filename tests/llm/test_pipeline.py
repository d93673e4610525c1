"""The corpus pipeline: every stage against brute force on its own input, and awkward tables."""

import random
import re
from collections import Counter

import pytest

from tests.llm.test_operators import lines_brute, text

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, keys string, size int, _row int"


def near_brute(rows):
    """Positions of the rows that stay: of each component of texts at Jaccard 0.8 or more that with the smallest doc_id."""
    low = {i: i + 32 for i in range(65, 91)}
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if root[x] != root[y] and (sets[x] == sets[y] or 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])):
                old, new = root[x], root[y]
                root = [new if r == old else r for r in root]
    least = {}
    for n, r in enumerate(root):
        least.setdefault(r, []).append((rows[n][0] is None, rows[n][0] or 0))
    return sorted(min(x) for x in least.values())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(31)
    line = "A line of more than forty code points that many of these documents hold."
    rows = [(i, text(rng, rng.randrange(10, 80)) + (f"\n{line}" if i % 4 == 0 else "") + (" you idiot you worthless scum" if i % 6 == 1 else "")) for i in range(240)]
    rows += [(300 + i, rows[i][1] + " once more") for i in range(12)]
    rows += [(400, None), (401, ""), (402, " \n "), (403, text(rng, 3000)), rows[20], rows[20], (None, rows[9][1]), (None, "only here " + text(rng, 30))]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    full = [(i, t, "en", (None, "a", "b", "c")[(i or 0) % 4], len(t) if t else None, "clash", 1, 2) for i, t in rows]
    spark.createDataFrame(full, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 1), 0) for i in range(200)] + [(None, 1, 1), (5, None, None)], "doc_id bigint, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_against_brute_force(spark, tables):
    import corpus_pipeline
    from mobilome_spark.llm import mixing, toxicity
    from mobilome_spark.llm.common import materialize, read_table

    docs = read_table(spark, tables, "documents")
    pair = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    key = lambda x: sorted(x, key=repr)
    given, stages = pair(docs), dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash", "mixing", "packing"]

    clean = materialize(stages["toxicity"](spark, docs, tables), "test")
    assert clean.columns == docs.columns
    scored = toxicity.toxicity(docs, read_table(spark, tables, "labels"), whole=True).filter("predicted = 0")
    kept = pair(clean)
    assert key(kept) == key([(r._row.doc_id, r._row.text) for r in scored.collect()])
    assert all("worthless scum" not in (t or "") for _, t in kept) and len(kept) > len(given) - 60

    lines = materialize(stages["line_dedup"](spark, clean, tables), "test")
    assert lines.columns == docs.columns
    want = lines_brute(kept)
    assert key((i, t or "") for i, t in pair(lines)) == key((i, t) for i, _, _, t in want)
    assert all((r.n_chars or 0) == len(r.text or "") for r in lines.collect())

    single = materialize(stages["simhash"](spark, lines, tables), "test")
    assert single.columns == docs.columns
    assert sorted((i is None, i or 0) for i, _ in pair(single)) == near_brute(pair(lines))

    mixed = materialize(stages["mixing"](spark, single, tables), "test")
    assert mixed.columns == docs.columns
    found = Counter(pair(mixed))
    held, of_source = Counter(), {}
    for r in mixing.mix(single).collect():
        of_source.setdefault((r.source_size, r.target), []).append(r)
        assert r.taken == r.size * r.copies and r.copies <= 2
        held[r.doc_id] += r.copies
    assert Counter(i for i, _ in found.elements()) == +held
    for (_, target), rows in of_source.items():  # no place is shared here, so a source misses its target by less than its longest document
        assert abs(sum(r.taken for r in rows) - target) <= max(r.size for r in rows)

    packed = stages["packing"](spark, mixed, tables).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(i for i, _ in found.elements())
    assert len(corpus_pipeline.run(spark, tables).collect()) == len(packed)


def test_empty_tables(spark, tables, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").filter("false").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_row_of_each_group_stays(spark):
    from mobilome_spark.llm.simhash_dedup import close_representatives, representatives

    rows = [(1, "one text of some words", 1), (None, "one text of some words", 2), (None, "another text of other words", 3), (None, "another text of other words", 3), (7, "ONE text of some words", 4), (8, "x", 5), (8, "y", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    for made in (representatives, close_representatives):
        got = made(docs)
        assert got.columns == docs.columns
        assert sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id) == [(1, rows[0][1]), (8, "x"), (8, "y")] and got.count() == 4


def test_edited_copies_are_not_compared_pair_by_pair(spark, monkeypatch):
    from mobilome_spark.llm import simhash_dedup

    rng, rows, compared, verify = random.Random(8), [], [], simhash_dedup._verified
    monkeypatch.setattr(simhash_dedup, "_verified", lambda pairs, texts: compared.append(pairs.distinct().count()) or verify(pairs, texts))
    for group in range(2):
        base = [f"w{group}x{rng.randrange(10**6)}" for _ in range(140)]
        for n in range(90):
            words = list(base)
            for at in rng.sample(range(140), n % 10):
                words[at] = f"e{rng.randrange(10**6)}"
            rows.append((1000 * group + rng.randrange(900) + n / 100, " ".join(words)))
    rows = [(int(i * 100), t) for i, t in rows]
    kept = simhash_dedup.close_representatives(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((False, r.doc_id) for r in kept.collect()) == near_brute(rows)
    assert sum(compared) < 10 * len(rows), compared


def test_hashes_are_made_for_compared_texts_only(spark, monkeypatch):
    """The hashes of all texts, twice the input, were written and shuffled to keep a tenth of them."""
    from mobilome_spark.llm import simhash_dedup

    rng, held, write = random.Random(9), [], simhash_dedup.materialize

    def watched(df, name):
        out = write(df, name)
        if "hashes" in df.columns:
            held.append((name, out.count()))
        return out

    monkeypatch.setattr(simhash_dedup, "materialize", watched)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, f"{t} more") for i, t in enumerate(texts[:5])] + [(200, texts[0]), (200, texts[0]), (300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for sent in (simhash_dedup.SENT, 0):
        monkeypatch.setattr(simhash_dedup, "SENT", sent)
        kept = simhash_dedup.close_representatives(docs)
        assert sorted((False, r.doc_id) for r in kept.collect()) == near_brute(rows)
    assert held == [("close-texts", 10)] * 2


def test_no_hot_key_meets_in_one_task(spark):
    from mobilome_spark.llm import common
    from mobilome_spark.llm.common import join_counted, materialize

    rows = materialize(spark.range(4000).selectExpr("if(id % 3 = 0, -1, id) as k", "id as v"), "rows")
    table = materialize(rows.groupBy("k").count().selectExpr("k", "count as _n", "k * 2 as w"), "table")
    kept, common.HOT_SHARE = common.HOT_SHARE, 100
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for how in ("inner", "left"):
            got = join_counted(rows, table.filter("k <> 5"), ["k"], 4000, how)
            sizes = [r["count"] for r in got.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()]
            assert got.count() == 4000 - (how == "inner") and max(sizes) < 1400, sizes
            assert got.filter("w <> 2 * k or (w is null and k <> 5)").count() == 0
    finally:
        common.HOT_SHARE = kept
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_language_codes_against_brute_force(spark):
    import numpy as np

    from mobilome_spark.llm import language_id as lid

    rng = random.Random(4)
    stems = {"aa": "ing ed the re".split(), "bb": "eau ux le oi".split(), "cc": "ung sch der ei".split(), "dd": "zion ato che gli".split(), "ee": "szcz ow nie rz".split()}
    rows = [(i, " ".join(rng.choice(stems[l]) + rng.choice(stems[l]) for _ in range(20)), l) for i in range(250) for l in [sorted(stems)[i % 5]]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = lid.fit(docs)
    for r in lid.language_id(docs, model).collect():
        x, losses = lid.features(rows[r.doc_id][1].encode()), []
        for word in model.code:
            loss = 0.0
            for bit, sign in enumerate(word):
                margin = sum(float(a) * float(b) for a, b in zip(x, model.w[:-1, bit], strict=True)) + model.w[-1, bit] if r.doc_id < 20 else float(x @ model.w[:-1, bit] + model.w[-1, bit])
                loss += model.weight[bit] * np.log1p(np.exp(-sign * max(-30.0, min(30.0, margin))))
            losses.append(loss)
        assert r.lang_pred == model.languages[int(np.argmin(losses))]


def test_toxicity_against_brute_force(spark):
    import zlib

    import numpy as np

    from mobilome_spark.llm import toxicity as tox

    rng = random.Random(5)
    rows = [(i, text(rng, 30) + (" you stupid clown" if i % 5 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = tox.fit(docs, spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id bigint, toxic int"))
    features = tox.Features(model.learned)
    for r in tox.toxicity(docs, None, model).collect():
        x, raw = features(rows[r._row.doc_id][1].encode()), model.trees.start
        for feature, cut, value in model.trees.nodes:  # one tree at a time, one row at a time
            at = 0
            for _ in range(model.trees.depth):
                f = feature[at]
                at = 2 * at + 1 + (sum(e < x[f] for e in model.trees.edges[f]) > cut[at])
            raw += value[at - (2**model.trees.depth - 1)]
        assert abs(r.score - float(np.clip(model.calibration(np.array([raw]))[0], 0, 1))) < 1e-9
        assert r.held_out == (zlib.crc32(str(r._row.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_join_hands_on_all_rows_to_leave_hot_keys_out(spark, monkeypatch):
    """An anti join made every row of other keys: as many rows as the input where a key was hot, none where no key was."""
    from mobilome_spark.llm import common
    from mobilome_spark.llm.common import join_counted, materialize

    monkeypatch.setattr(common, "HOT_SHARE", 100)
    rows = materialize(spark.range(4000).selectExpr("if(id % 11 = 0, null, if(id % 3 = 0, -1, id)) as k", "cast(id % 2 as int) as l", "id as v"), "rows")
    table = rows.filter("k is not null").groupBy("k", "l").count().selectExpr("k", "cast(l as bigint) as l", "count as _n", "k * 2 as w")
    table = materialize(table.filter("k <> 5"), "table")
    assert table.filter("_n * 100 >= 4000").count() == 2
    for how in ("inner", "left"):
        got = join_counted(rows, table, ["k", "l"], 4000, how)
        assert "Anti" not in plan_of(got)
        want = [(k, v, None if k in (None, 5) else 2 * k) for v in range(4000) for k in [None if v % 11 == 0 else -1 if v % 3 == 0 else v]]
        want = [x for x in want if how == "left" or x[2] is not None]
        assert sorted(((r.v, r.k, r.w) for r in got.collect())) == [(v, k, w) for k, v, w in want]
        monkeypatch.setattr(common, "NAMED", 0)  # more hot keys than are named
        assert "Anti" in plan_of(join_counted(rows, table, ["k", "l"], 4000, how))
        assert join_counted(rows, table, ["k", "l"], 4000, how).count() == len(want)
        monkeypatch.undo()
        monkeypatch.setattr(common, "HOT_SHARE", 100)


def test_few_edges_take_one_table(spark, monkeypatch):
    """Each round of few edges wrote four tables and ran seven jobs, each of as many tasks as there are partitions."""
    from mobilome_spark.llm import components

    rng, written, write = random.Random(12), [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: written.append(name) or write(df, name))
    chain = list(range(-60, 60))
    rng.shuffle(chain)
    edges = [(x, y) for x, y in zip(chain[:90], chain[1:91], strict=True)] + [(1 << 62, -(1 << 62)), (7, 7), (-(1 << 62), 1 << 62)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)]
    root = {x: x for e in edges for x in e}
    for x, y in edges:
        low, high = sorted((root[x], root[y]))
        root = {k: low if r == high else r for k, r in root.items()}
    linked = {x for x, y in edges if x != y} | {y for x, y in edges if x != y}
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    for most in (components.LOCAL, 0):
        monkeypatch.setattr(components, "LOCAL", most)
        written.clear()
        got = [(r.node, r.root) for r in components.connected_components(frame).collect()]
        assert sorted(got) == sorted((k, r) for k, r in root.items() if k in linked)
        assert len(written) == 1 if most else len(written) > 3
        assert components.connected_components(frame.filter("false")).count() == 0


def test_pairs_of_an_often_compared_text_are_dealt_out(spark, monkeypatch):
    from mobilome_spark.llm import simhash_dedup

    rng, rows = random.Random(13), []
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    for n in range(60):
        words = list(base)
        for at in rng.sample(range(150), n % 9):
            words[at] = f"e{rng.randrange(10**6)}"
        rows.append((n, " ".join(words)))
    rows += [(100 + n, " ".join(f"x{rng.randrange(10**6)}" for _ in range(20))) for n in range(10)] + [(n + 200, rows[3][1]) for n in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for compared in (4096, 7):
        monkeypatch.setattr(simhash_dedup, "COMPARED", compared)
        assert sorted((False, r.doc_id) for r in simhash_dedup.close_representatives(docs).collect()) == near_brute(rows)


def test_packing_program_holds_each_pair_once():
    """On the driver: the pairs of some hundred thousand configurations took most of its memory."""
    import numpy as np

    from mobilome_spark.llm.packing import program

    counts = np.zeros(301, np.int64)
    counts[1:300] = np.random.default_rng(14).integers(1, 400, 299)
    held = [pair for config, _ in program(counts, 300, rounds=60)[0] for pair in config]
    assert len(held) > 3000 and len({id(pair) for pair in held}) == len(set(held))
