"""The training-data operators against brute force on small, awkward tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    shared = text(rng, 30)
    line = "This is a line that very many of the documents hold, word for word."
    out = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "one two"), (5, "ONE Two"), (6, "é" * 50 + "\n" + "É" * 50)]
    for i in range(7, 40):
        body = text(rng, rng.randrange(5, 60))
        if i % 3 == 0:
            body = f"{body}\n{line if i % 2 else '  ' + line.upper() + chr(9)}\n{text(rng, 4)}"
        if i % 5 == 0:
            body += " " + shared
        out.append((i, body))
    out += [(50 + k, out[20 + k][1]) for k in range(3)] + [out[25], (60, text(rng, 5000)), (None, shared)]
    return out


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, ("en", "fr")[(i or 0) % 2], f"s{(i or 0) % 3}" if i != 9 else None, "clash", 1) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, keys string, size int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def lines_brute(corpus):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    held = {}
    for i, t in corpus:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(i)
    often = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = []
    for i, t in corpus:
        every = (t or "").split("\n")
        kept = [x for x in every if often.get(key(x), i) == i]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(docs, corpus, empty):
    from mobilome_spark.llm.line_dedup import cleaned_documents, line_dedup

    got = [(r._row.doc_id, r._n_lines, r._n_dropped, r._kept or "") for r in line_dedup(docs).collect()]
    assert sorted(got, key=repr) == sorted(lines_brute(corpus), key=repr)
    assert cleaned_documents(docs).columns == docs.columns
    assert line_dedup(empty).count() == 0


def test_line_index_is_reversible(spark, docs):
    from mobilome_spark.llm.line_dedup import LineIndex

    index = LineIndex(spark).insert(docs)
    dropped = lambda: sum(r._n_dropped for r in index.clean(docs).collect())
    before = dropped()
    gone = docs.filter("doc_id % 9 <> 0")
    index.delete(gone)
    assert before > 0 and dropped() == 0
    index.insert(gone)
    assert dropped() == before
    again = LineIndex.open(spark, index.folder)  # from the folder alone
    assert sum(r._n_dropped for r in again.clean(docs).collect()) == before
    again.delete(docs.filter("doc_id = -5"))
    assert sum(r._n_dropped for r in again.clean(docs).collect()) == before
    new = LineIndex(spark)
    assert new.delete(docs).counts().count() == 0 and sum(r._n_dropped for r in new.clean(docs).collect()) == 0


def test_line_counts_after_changes(spark, docs, monkeypatch):
    from mobilome_spark.llm import line_dedup

    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    monkeypatch.setattr(line_dedup, "ASKED", 4)  # several shards and parts
    monkeypatch.setattr(line_dedup, "RUNS", 1)
    some, rest = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1 or doc_id is null")
    index = line_dedup.LineIndex(spark, min_docs=2, min_length=5).insert(some).insert(rest)
    whole = line_dedup.LineIndex(spark, min_docs=2, min_length=5).insert(docs)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(index.frequent) == rows(whole.frequent) and index.state["shards"] > 1
    assert sorted(map(repr, index.clean(docs).collect())) == sorted(map(repr, whole.clean(docs).collect()))
    index.delete(rest)
    assert rows(index.frequent) == rows(line_dedup.LineIndex(spark, min_docs=2, min_length=5).insert(some).frequent)


def test_cuckoo_filter():
    from mobilome_spark.llm.cuckoo import CuckooFilter

    rng = np.random.default_rng(1)
    keys, others = rng.integers(-(2**62), 2**62, 5000), rng.integers(-(2**62), 2**62, 20000)
    f = CuckooFilter.from_bytes(CuckooFilter.build(keys).to_bytes())
    assert f.contains(keys).all() and f.contains(others).mean() < 0.002
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01


@pytest.mark.parametrize("hot", [512, 0])
def test_simhash(docs, corpus, empty, hot):
    from mobilome_spark.llm.simhash_dedup import near_duplicates

    low = {i: i + 32 for i in range(65, 91)}
    prints = {}
    for i, t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w))]
        prints[i, t] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {k: k for k in prints}

    def find(x):
        return x if root[x] == x else find(root[x])

    every = sorted(prints, key=lambda k: (k[0] is None, k[0] or 0))
    for n, a in enumerate(every):
        for b in every[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)), key=every.index)
                root[y] = x
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs, hot=hot).collect()), key=repr)
    assert got == sorted(((i, f"{prints[i, t]:016x}", find((i, t))[0]) for i, t in corpus), key=repr)
    assert near_duplicates(empty).count() == 0


def test_components_follow_long_chains(spark):
    from mobilome_spark.llm.components import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 900: 900, 901: 900}


@pytest.mark.parametrize("most", [4096, 2])  # 2: packed twice
def test_substring_dedup(docs, corpus, empty, monkeypatch, most):
    from mobilome_spark.llm import substring_dedup as module

    monkeypatch.setattr(module, "MOST_BUCKETS", most)
    monkeypatch.setattr(module, "AGAIN", 50)
    monkeypatch.setattr(module, "GROUP_BYTES", 4096)
    from mobilome_spark.llm.substring_dedup import substring_dedup

    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in corpus]
    first = {}
    for i, w in split:
        for k in range(len(w) - 12):
            s = tuple(w[k : k + 13])
            first[s] = min(first.get(s, 10**9), 10**8 if i is None else i)
    want = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (10**8 if i is None else i):
                gone.update(range(k, k + 13))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(x[2] for x in want) > 100
    assert substring_dedup(empty).count() == 0


def test_substring_dedup_of_words_that_sum_alike(spark):
    from mobilome_spark.llm.substring_dedup import substring_dedup

    # Thue-Morse words and their complements: sums of powers modulo 2**64 can't tell them apart
    word = "".join("ab"[k.bit_count() % 2] for k in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, " ".join([word] * 13)), (2, " ".join([other] * 13)), (3, " ".join([other] * 14))], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup(docs).collect()) == [(1, 0), (2, 0), (3, 14)]


def test_toxicity(spark, docs, empty):
    from mobilome_spark.llm.toxicity import toxicity

    rng = random.Random(2)
    rows = [(i, text(rng, 40) + (" you idiot, you worthless scum " + text(rng, 5) if i % 4 == 0 else "")) for i in range(400)] + [(900, None), (901, ""), (None, "you idiot")]
    many = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    got = {r._row.doc_id: r for r in toxicity(many, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].predicted == (i % 4 == 0) for i in range(400) if got[i].held_out)
    assert got[900].score == got[901].score and not got[None].held_out
    assert toxicity(empty, labels).count() == 0
    assert {r.predicted for r in toxicity(docs, labels.filter("false")).collect()} == {0}


def test_neighbours(spark):
    from mobilome_spark.llm.ann import neighbours

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[40:80] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (420, []), (440, [0.0] * 16), (460, [float("nan")] * 16), (480, [1.0, None] * 8), (500, [2.0, 1.0])]
    got = neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = []
    for q in range(0, 300, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        want = np.lexsort((np.arange(300), -s))[:20]
        have = [v for _, v, _ in sorted(found[q])]
        hits.append(len(set(want) & set(have)) / 20)
        assert [k for k, _, _ in sorted(found[q])] == list(range(1, 21))
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in found[q])
    assert np.mean(hits) >= 0.9 and not {400, 420, 440, 460, 480, 500} & set(found)
    assert neighbours(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    few = neighbours(spark.createDataFrame(rows[:18:1], "vec_id bigint, embedding array<float>")).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, k) for k in range(1, 18)]  # all candidates


def test_neighbours_with_more_projections(spark, monkeypatch):
    from mobilome_spark.llm import ann

    monkeypatch.setattr(ann, "BUCKET", 0.1)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    assert ann.projections(400) == 5
    found = {}
    for r in ann.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    s = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(s, -np.inf)
    assert np.mean([len(found[q] & set(np.argsort(-s[q])[:20].tolist())) / 20 for q in range(0, 400, 20)]) >= 0.9


def test_mixing(docs, corpus, empty):
    from mobilome_spark.llm.mixing import mix, mixed_documents

    got = mix(docs).collect()
    again = mix(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, len((t or "").split())) for i, t in corpus)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    targets = {(r.source_size, r.target) for r in got}
    total = sum(s for s, _ in targets)
    assert abs(sum(t for _, t in targets) - 1.5 * total) < 1e-6 and all(t <= 2 * s + 1e-9 for s, t in targets)
    assert mixed_documents(docs).columns == docs.columns
    assert mix(empty).count() == 0 and mixed_documents(empty).count() == 0


def test_packing(docs, corpus, empty):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from mobilome_spark.llm.packing import pack

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, x in corpus:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        start, size, piece = 0, len(ids) % 256 or 256, 0
        while start < len(ids):
            want.append((i, piece, start, size, zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes())))
            start, size, piece = start + size, 256, piece + 1
    got = pack(docs, capacity=256).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    least = -(-sum(w[3] for w in want) // 256)
    assert len(filled) <= least * 1.05 + 1
    assert pack(empty).count() == 0


def test_encoder_equals_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    from mobilome_spark.llm.packing import encoder, ranked_vocabulary

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(3)
    ranked = ranked_vocabulary(path)
    assert ranked is not None
    t, encode = Tokenizer.from_file(path), encoder(path, ranked)
    assert list(encoder(path, None)("a bc")) == list(encode("a bc"))
    odd = ["", "I'LL it's x", "a<|endoftext|>b", "　\x85 \n\n x ", "é" * 300]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), 10, 32, 0x1F600])) for _ in range(50)) for _ in range(300)]
    assert all(t.encode(x, add_special_tokens=False).ids == list(encode(x)) for x in odd)


def test_language_id(spark, empty):
    from mobilome_spark.llm.language_id import UNKNOWN, codewords, language_id

    rng = random.Random(6)
    stems = {"aa": "ing ed the re".split(), "bb": "eau ux le oi".split(), "cc": "ung sch der ei".split()}
    rows = [(i, " ".join(rng.choice(stems[l]) + rng.choice(stems[l]) for _ in range(30)), l) for i in range(300) for l in [sorted(stems)[i % 3]]]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !", None), (None, "the theing", None)]
    got = {r.doc_id: r for r in language_id(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    held = [(got[i].lang_pred, l) for i, _, l in rows[:300] if got[i].held_out]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.95
    assert all(got[i].lang_pred == UNKNOWN for i in (900, 901, 902)) and got[None].lang_pred == "aa"
    assert language_id(empty).count() == 0
    code = codewords(9)
    assert min((code[i] != code[j]).sum() for i in range(9) for j in range(i)) >= 8


def test_media(docs, corpus, empty):
    from mobilome_spark.llm import avi, media

    for body in (b"", b"x" * 63, b"y" * 64, bytes(range(256)) * 40, b"\xff" * 9000):
        payload, n, _, _ = media.read(avi.encode(media.pad(body), len(body)))
        assert payload == media.pad(body) and n == len(body)
    rng = np.random.default_rng(0)
    few = lambda *shape: rng.integers(-200, 200, (*shape, 64)) * (rng.random((*shape, 64)) < 0.3)
    blocks = few(3, 4)
    assert (avi.decode_frame(avi.encode_coefficients([(1, 1, blocks)], 32, 24)) == blocks.reshape(-1, 64)).all()
    for usual in (False, True):  # luma at twice the resolution of two colours
        parts = [(2, 2, few(4, 6)), (1, 1, few(2, 3)), (1, 1, few(2, 3))]
        frame = avi.parse_frame(avi.encode_coefficients(parts, 44, 30, 3, usual))
        assert all((p.blocks == want).all() for p, (_, _, want) in zip(frame.parts, parts, strict=True))
        assert avi.pixels(frame).shape == (30, 44) and avi.pixels(frame, 2).shape == (15, 22)
    # the inverse transform against its definition
    c = [np.sqrt(0.5) if k == 0 else 1.0 for k in range(8)]
    plain = np.zeros(64)
    plain[avi.ZIGZAG] = parts[0][2][0, 0] * 3
    for x, y in ((0, 0), (3, 7), (6, 2)):
        want = sum(c[u] * c[v] / 4 * plain[8 * u + v] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) + 128
        assert abs(int(avi.pixels(frame)[x, y]) - min(255, max(0, want))) <= 1
    assert [a for a, _ in media.shots(np.repeat(np.eye(32)[[0, 5]], 4, axis=0))] == [0, 4]
    odd = [(1, None), (2, b""), (3, b"RIFF"), (4, avi.encode(media.pad(b"abc"), 3)[:-40]), (5, avi.encode(media.pad(b"abc"), 3))]
    read = {r.doc_id: r for r in media.decode(docs.sparkSession.createDataFrame(odd, "doc_id bigint, media binary")).collect()}
    assert [read[k].n_bytes for k in range(1, 6)] == [None, None, None, None, 3] and [read[k].media_bytes for k in (1, 2, 3)] == [None, 0, 4] and len(read[5].clips) == 1
    got = media.media_columns(docs).collect()
    want = sorted((i is None, i or 0, len((t or "").encode()), hashlib.sha256(media.pad((t or "").encode())).hexdigest()) for i, t in corpus)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.payload_sha256) for r in got) == want
    import zlib

    texts = {hashlib.sha256(media.pad((t or "").encode())).hexdigest(): (t or "").encode() for _, t in corpus}
    for r in got:
        stored = avi.encode(media.pad(texts[r.payload_sha256]), len(texts[r.payload_sha256]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert (r.payload_bytes, r.tail_crc32) == (len(media.pad(texts[r.payload_sha256])), zlib.crc32(media.pad(texts[r.payload_sha256])[-64:]))
        assert r.feature.startswith(f"{r.clips[-1].to_frame}:{len(r.clips)}:") and r.clips[0].from_frame == 0
    assert len({(r.payload_sha256, r.n_bytes, r.feature) for r in got}) == len({(r.payload_sha256, r.n_bytes) for r in got})
    assert media.media_columns(empty).count() == 0


def test_warc(spark):
    from mobilome_spark.llm.warc import assemble, captures, read_records, write_archives

    big, other = "<p>" + "x" * 200, "<p>é" + "y" * 200
    rows = [(1, "http://a/b?q", big), (2, None, big), (3, "http://c", other), (4, "", None), (5, "", ""), (6, "u", "short"), (7, "u", "short"), (2, None, big), (None, "n", other)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in captures(pages).collect()), key=repr)
    first = {big: 1, other: 3}
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        f = first.get(h)
        want.append((i, len(body), "response" if f in (None, i) else "revisit", None if f in (None, i) else f, hashlib.sha256(body).hexdigest()))
    assert got == sorted(want, key=repr)
    whole = assemble(read_records(write_archives(pages))).collect()
    assert len(whole) == len(rows) and all(r.request and r.metadata for r in whole)
    assert captures(pages.filter("false")).count() == 0


@pytest.mark.parametrize("times", [1, 50])
def test_packing_program_places_most(monkeypatch, times):
    from mobilome_spark.llm import packing

    rng = np.random.default_rng(5)
    counts = np.bincount(np.clip(rng.lognormal(4, 1, 20_000).astype(int), 1, 255), minlength=257) * times
    fitted, best_fit = [], packing._best_fit
    monkeypatch.setattr(packing, "_best_fit", lambda left, capacity: fitted.append(left.copy()) or best_fit(left, capacity))
    found, sizes = packing.solve(counts, 256), np.arange(257)
    held = np.zeros(257, np.int64)
    for config, n in found:
        assert sum(l * k for l, k in config) <= 256
        for l, k in config:
            held[l] += k * n
    assert (held == counts).all()
    assert sum(int(x @ sizes) for x in fitted) < 0.1 * int(counts @ sizes)
    assert sum(n for _, n in found) <= 1.005 * int(counts @ sizes) / 256 + 1


def test_packing_program_meets_its_bound():
    from mobilome_spark.llm.packing import GAP, program

    for counts in ({30: 40, 20: 3}, {26: 60, 12: 50, 7: 9}, {50: 5}):  # more than the tokens' number is needed
        need = np.zeros(51, np.int64)
        need[list(counts)] = list(counts.values())
        solution, total, bound = program(need, 50)
        covered = sum(n * times * (np.arange(51) == l) for config, times in solution for l, n in config)
        assert (covered >= need * (1 - 1e-9)).all() and bound <= total <= bound * (1 + GAP)


def test_toxicity_scores_keep_the_base_rate(spark, monkeypatch):
    from mobilome_spark.llm import toxicity

    # a word that a fifth of its documents are toxic with: its score is that share, however many clean labels are sampled
    rng = random.Random(8)
    rows = [(i, text(rng, 20) + (" grumble" if i % 2 else "")) for i in range(12_000)]
    labels = [(i, int(i % 2 and rng.random() < 0.2)) for i in range(12_000)]
    many, known = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE", 800)
    model = toxicity.fit(many, known)
    assert abs(model.base - 0.1) < 0.03
    got = [r.score for r in toxicity.toxicity(many, known, model).filter("held_out").collect()]
    assert abs(np.mean(got) - 0.1) < 0.03


def test_pipeline_near_copies(spark, docs, corpus, empty):
    import corpus_pipeline

    rng = random.Random(21)
    rows = list(corpus)
    for i in range(30):  # copies with a few words replaced, most of them at similarities from 0.75 to 1
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((1000 + 3 * i, " ".join(words)))
        for k in (1, 2):
            for at in rng.sample(range(200), rng.randrange(1, 6)):
                words[at] = "changed"
            rows.append((1000 + 3 * i + k, " ".join(words)))
    low = {i: i + 32 for i in range(65, 91)}
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0))
    root = list(range(len(rows)))
    for x in order:
        for y in order:
            if sets[x] == sets[y] or 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                old, new = root[x], root[y]
                root = [new if r == old else r for r in root]
    first = {}
    for n in order:
        first.setdefault(root[n], rows[n][0])
    many = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id for r in corpus_pipeline.simhash(spark, many, "").collect()}
    assert got == set(first.values()) and len(got) < len({i for i, _ in rows}) - 40
    assert corpus_pipeline.simhash(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.simhash(spark, empty, "").count() == 0


def test_neighbours_of_isolated_vectors(spark):
    from mobilome_spark.llm.ann import neighbours

    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(80, 64)), 50, axis=0) + 0.02 * rng.normal(size=(4000, 64))
    alone = np.arange(0, 4000, 100)  # every fifth query stands alone
    x[alone] = rng.normal(size=(40, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    found = {}
    for r in neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    s = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(s, -np.inf)
    recall = [len(found.get(q, set()) & set(np.argsort(-s[q])[:20].tolist())) / 20 for q in alone]
    assert np.mean(recall) >= 0.9, np.mean(recall)
