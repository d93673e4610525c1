"""Duplications spelled out by clips, against a loop over all places."""

import random
import time

from mobilome_spark.operators import refine

LOCI = "chrom string, window_start bigint, window_end bigint, window_seq string, centre int"
CLIPS = "chrom string, window_start bigint, window_end bigint, sample string, clip_side string, bp bigint, orientation string, clip_seq string"
TURN = str.maketrans("ACGT", "TGCA")


def by_loops(loci, clips):
    votes = {}
    for *key, sample, side, bp, orientation, clip in clips:
        window, centre = next((x[3:] for x in loci if list(x[:3]) == key), (None, 0))
        if window is None or clip is None or bp is None:
            continue
        turned = clip.translate(TURN)[::-1]
        found = []
        for variant, prox in enumerate({"+": [clip], "-": [turned]}.get(orientation, [clip, turned])):
            for n in range(4, min(30, len(prox)) + 1):
                motif = prox[-n:] if side == "L" else prox[:n]
                left = bp if side == "L" else bp - n + 1
                if "N" in motif or left < 1:
                    continue
                for i in range(len(window) - n + 1):
                    bad = sum(a != b for a, b in zip(window[i : i + n], motif, strict=True))
                    if bad <= 1:
                        found.append((-n, bad, abs(i - centre), variant, left))
        if found:
            n, bad, distance, _, left = min(found)
            source = f"tsd_{sample}_{side}_clip_{'near_' * (bad > 0)}exact_rescue"
            votes.setdefault((*key, n, left, source, sample != "disease", side != "L"), []).append((bad, distance))
    best = {}
    for (*key, n, left, source, turn, is_right), v in votes.items():
        if len(v) > 1:
            best.setdefault(tuple(key), []).append((n, -len(v), *min(v), turn, is_right, left, source))
    return {k: (x[-2], x[-2] - x[0] - 1, -x[0], x[-1]) for k, rows in best.items() for x in [min(rows)]}


def found(spark, loci, clips):
    rows = refine.clip_exact_tsd(spark.createDataFrame(loci, LOCI), spark.createDataFrame(clips, CLIPS)).collect()
    return {tuple(r)[:3]: tuple(r)[3:] for r in rows}


def test_clip_duplications_match_a_loop(spark):
    rng = random.Random(11)
    text = lambda n, kinds="ACGT": "".join(rng.choice(kinds) for _ in range(n))
    loci = [("1", i, i, text(rng.choice([0, 3, 20, 70])), rng.randrange(70)) for i in range(40)] + [("1", 99, 99, None, 3)]
    clips = []
    for key in loci:
        window = key[3] or "ACGT"
        for _ in range(rng.randrange(25)):
            i = rng.randrange(max(1, len(window) - 12))
            clip = text(rng.randrange(3), "ACGTN") + window[i : i + rng.randrange(1, 45)] + text(rng.randrange(3), "ACGTN")
            if rng.random() < 0.3:
                clip = clip.translate(TURN)[::-1]
            if rng.random() < 0.3 and clip:
                j = rng.randrange(len(clip))
                clip = clip[:j] + "T" + clip[j + 1 :]
            clips += [(*key[:3], rng.choice(["disease", "control"]), rng.choice("LR"), rng.choice([0, 3, 8, 500, None]), rng.choice(["+", "-", None, "?"]), rng.choice([clip, clip, clip, None]))] * rng.randrange(1, 3)
    want = by_loops(loci, clips)
    assert len(want) > 10
    assert found(spark, loci, clips) == want
    assert found(spark, loci, []) == {}


def test_many_clips_end_in_time(spark):
    """Each clip was sought in each of its lengths by nested expressions: 90 s and more for as many."""
    rng = random.Random(12)
    loci = [("1", i, i, "".join(rng.choice("ACGT") for _ in range(161)), 80) for i in range(1000)]
    clips = [(*k[:3], "disease", "L", 500, None, k[3][j : j + 40]) for k in loci for j in rng.choices(range(100), k=60)]
    began = time.time()
    got = found(spark, loci, clips)
    assert time.time() - began < 60
    assert set(got) <= {k[:3] for k in loci} and len(got) > 900 and {v[2] for v in got.values()} == {30}
