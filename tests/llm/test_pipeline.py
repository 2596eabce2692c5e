"""run() against its stages written plainly, on a fixture where every stage acts."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessel.llm import lines, queries, toxicity

TOXIC = "you stupid worthless idiot shut up you trash".split()


def fixture(spark, where):
    rng = np.random.default_rng(21)
    vocabulary = [f"{a}{b}" for a in "ba be bi bo bu da de di do du fa fe fi fo fu ga ge gi go gu".split() for b in "ran ret ril rop rum lan let lin lop lus".split()]
    own = lambda n: " ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), n))
    docs, labels = [], []
    for i in range(160):
        toxic = i % 4 == 3
        words = own(60).split()
        for at in rng.integers(0, 60, 12 if toxic else 0):
            words[at] = TOXIC[rng.integers(len(TOXIC))]
        docs.append([i, "\n".join([" ".join(words[:30]), " ".join(words[30:])]), f"s{i % 14}"])
        if i % 3:
            labels.append((i, 1, int(toxic)))
    clean = [d for d in docs if d[0] % 4 != 3]
    banner, passage, bench = "all rights reserved by the house", own(60), own(40)
    for d in clean[:30]:
        d[1] += "\n" + banner
    for k, d in enumerate(clean[30:36]):
        d[1] += "\n" + passage
        d[2] = f"s{k % 3}"
    for d in clean[40:44]:
        d[1] += "\n" + bench[: len(bench) // (1 + d[0] % 2)]
    copy = [[1000 + k, d[1], "s1"] for k, d in enumerate(clean[50:56])]
    near = [[2000 + k, d[1].replace(d[1].split()[7], "zzz", 1), "s2"] for k, d in enumerate(clean[56:60])]
    rows = [*docs, *copy, *near, [3000, None, None], [3001, "", "s1"], [3002, "\n".join(own(3000) for _ in range(4)), "s3"]]
    at = f"{where}/fixture"
    spark.createDataFrame(
        [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, bench), (2, own(5))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, bench


def plain_lines(rows):
    seen = {}
    for i, text, source in sorted(rows):
        for no, line in enumerate((text or "").split("\n")):
            if key := " ".join(line.split()):
                seen.setdefault(key, []).append((i, no, source))
    out = []
    for i, text, source in rows:
        if text is None:
            out.append((i, text, source))
            continue
        wide, long = [], []
        for no, line in enumerate(text.split("\n")):
            key = " ".join(line.split())
            sites = {s for _, _, s in seen.get(key, ())}
            if key and seen[key][0][:2] != (i, no):
                if len(sites) >= lines.MIN_SITES:
                    wide.append(no)
                elif len(key.split()) > lines.LONG_WORDS and len(sites) >= lines.LONG_SITES:
                    long.append((no, len(key.split())))
        if 2 * sum(n for _, n in long) <= len(text.split()):
            wide += [no for no, _ in long]
        left = "\n".join(line for no, line in enumerate(text.split("\n")) if no not in wide)
        if not wide or left.strip(" "):
            out.append((i, left, source))
    return out


def plain_copies(rows):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(text) for i, text, _ in rows}
    part = {i: i for i in sets}
    for _ in sets:
        moved = False
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and part[j] < part[i] and 100 * len(a & b) >= 75 * len(a | b):
                    part[i], moved = part[j], True
        if not moved:
            break
    return [r for r in rows if part[r[0]] == r[0]]


def plain_contaminated(rows, item):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda text: re.findall(pattern, (text or "").lower())
    window = {tuple(words(item)[k : k + 13]) for k in range(len(words(item)) - 12)}
    kept = []
    for r in rows:
        w, hit = words(r[1]), set()
        for k in range(len(w) - 12):
            if tuple(w[k : k + 13]) in window:
                hit.update(range(k, k + 13))
        if not hit or 20 * len(hit) < len(w):
            kept.append(r)
    return kept


def test_run(spark, tmp_path):
    from tokenizers import Tokenizer

    at, rows, bench = fixture(spark, tmp_path)
    docs, labels = (spark.read.parquet(f"{at}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit_on_rest(docs, labels)
    toxic = {r[0] for r in toxicity.scored(docs, model).where("score >= 0.5").select(F.col("row.doc_id")).collect()}
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert 20 <= len(toxic) and np.mean([(i in toxic) == bool(t) for i, t in known.items()]) > 0.9
    sizes = [len(rows)]
    left = [r for r in rows if r[0] not in toxic]
    for step in (plain_lines, plain_copies, lambda x: plain_contaminated(x, bench)):
        sizes.append(len(left))
        left = step(left)
    sizes.append(len(left))
    assert sizes[0] > sizes[1] and sizes[2] > sizes[3] > sizes[4] and left != [r for r in rows if r[0] in {x[0] for x in left}]
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, text, _ in left:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(i, k, s, len(ids[s : s + 4096]), zlib.crc32(np.asarray(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    got = corpus_pipeline.run(spark, at).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == sorted(want)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in parts) <= 4096 and all(o == sum(m for p, m in parts if p < o) for o, _ in parts) for parts in held.values())
