"""Operators 11 to 13 against brute force and public libraries, on planted cases and odd rows."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomspark.llm import audit, bpe, merkle

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, part string, ids string, size int, digest string, mask int"


def docs(spark, rows):
    """rows of (doc_id, source, text), with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "p", "i", 1, "d", 2) for i, s, t in rows], DOC)


LONG = "Word " * 30_000
ODD = [
    (None, "a", "null id"), (None, "a", "null id"), (1, "a", None), (2, "a", ""), (2, "a", ""), (3, None, ""), (4, "a", "Some text\nwith lines\n"), (4, "a", "Some text\nwith lines\n"), (4, "b", "Some text\nwith lines\n"),
    (5, "b", "Some text\nwith lines\n"), (6, "", LONG), (7, "", LONG), (8, "é", "漢字 A$B é " * 60), (9, "c", "x\n\ny"), (-3, "c", "Some text\nwith lines\n"), (10, "é", "x" * 70_000),
]


def real(spark):
    return [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").collect()]


# operator 11


def plain_mask(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    return (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * capitals > 2 * len(text)) + 8 * any(c in "#$%&*|" for c in text)


def plain_audit(rows, labels):
    """The report with sets of rows, one order and one document at a time."""
    lowest = {}
    for i, _, t in rows:
        if i is not None:
            lowest[t or ""] = min(i, lowest.get(t or "", i))
    masks = [(s or "", plain_mask(t or "") + 16 * (i is not None and i > lowest[t or ""]), labels.get(i, (0, 0)) if i is not None else (0, 0)) for i, s, t in rows]
    out = {}
    for part in {m[0] for m in masks}:
        own, total = [m for m in masks if m[0] == part], dict.fromkeys(range(5), 0)
        for order in itertools.permutations(range(5)):
            left = own
            for step, f in enumerate(order, 1):
                gone = [m for m in left if m[1] >> f & 1]
                left = [m for m in left if not m[1] >> f & 1]
                fails = sum(m[1] >> f & 1 for m in own)
                total[f] += len(gone)
                out[part, "".join("ABCDE"[x] for x in order), step] = (f, len(left), len(gone), fails - len(gone), sum(m[1] == 1 << f for m in own), sum(m[2][0] == 1 for m in gone), sum(m[2][1] == 1 for m in gone))
        for key in [k for k in out if k[0] == part]:
            f, *rest = out[key]
            out[key] = (*rest, total[f])
    return out


def audited(spark, rows, labels):
    table = spark.createDataFrame([(i, q, t) for i, (q, t) in labels.items()], "doc_id long, quality int, toxic int")
    found = audit.audit(docs(spark, rows), table).collect()
    return {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in found}


@pytest.mark.parametrize("chain", [audit.CHAIN, 0])
def test_audit_matches_brute_force(spark, monkeypatch, chain):
    monkeypatch.setattr(audit, "CHAIN", chain)
    rows = real(spark)
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert audited(spark, rows, labels) == plain_audit(rows, labels)


def test_audit_of_odd_rows_and_hot_copies(spark):
    rng = random.Random(2)
    rows = ODD + [(100 + i, rng.choice("ab"), "one text for all") for i in range(400)] + [(i, "b", f"text {i % 7}") for i in range(1000, 1060)]
    rng.shuffle(rows)
    labels = {1: (1, 0), 4: (1, 1), 5: (0, 1), 7: (1, None), 101: (1, 1), 77: (1, 1)}
    assert audited(spark, rows, labels) == plain_audit(rows, {k: (q, t or 0) for k, (q, t) in labels.items()})
    got = {r.doc_id for r in audit.copies(docs(spark, rows).repartition(5)).collect()}
    lowest = {t or "": min(i for i, _, u in rows if i is not None and (u or "") == (t or "")) for i, _, t in rows if i is not None}
    assert got == {i for i, _, t in rows if i is not None and i > lowest[t or ""]}
    assert audit.audit(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_texts_of_one_hash_are_told_apart():
    chains = {}
    found = [x for row in [(9, b"a", 3), (9, b"b", 1), (9, b"a", 2), (9, b"b", 4), (9, b"a", 2)] for x in audit.chained(chains, row[0], row[1], row[2], {"p": 1}, 0)]
    assert found == [(3, "p", audit.COPY, 1), (4, "p", audit.COPY, 1)] and chains[9] == {b"a": [2, {"p": 2}, 0], b"b": [1, {"p": 1}, 0]}


# operator 12


def library():
    import public_tokenizers
    import tiktoken

    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tokens, public_tokenizers.PATTERN, tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def odd_texts():
    rng = random.Random(1)
    return [
        "<|endoftext|> and <|x|>", "", None, " \n\t\r\n  x     y", "I'll we've 'S don’t", "1234567890 ١٢٣ ²", "漢字😀é‍👩‍👩‍👧", "".join(chr(rng.randrange(1, 0x3000)) for _ in range(3000)),
        "".join(rng.choice("ab") for _ in range(20_000)), *("".join(rng.choice("etaoinshr ") for _ in range(200)) for _ in range(20)), "\U0010ffff￾\x00\x7f", "x" * 50_000,
    ]


@pytest.mark.parametrize("block, memo", [(bpe.BLOCK, bpe.MEMO), (50, 8)])
def test_ids_are_those_of_the_library(spark, monkeypatch, block, memo):
    monkeypatch.setattr(bpe, "BLOCK", block)
    monkeypatch.setattr(bpe, "MEMO", memo)
    tokens, pattern, plain = library()
    vocabulary = bpe.Vocabulary.build(tokens)
    import pyarrow as pa
    import regex

    encoder, split = bpe.Encoder(vocabulary), regex.compile(pattern)
    for text in [*odd_texts(), *(t for _, _, t in real(spark)[:60])]:
        got = [i for words, _ in bpe._blocks(pa.array([text], pa.string()), split) for i in encoder.encoded(words)[0].tolist()]
        assert got == plain.encode_ordinary(text or "")


def test_hash_is_perfect_and_minimal():
    tokens, _, _ = library()
    v = bpe.Vocabulary.build(tokens)
    assert v.ranks(tokens).tolist() == list(range(len(tokens))) and sorted(v.slots.tolist()) == list(range(len(tokens)))
    assert v.ranks([b"", b"no such token at all", tokens[5] + b"\xff"]).tolist() == [-1, -1, -1]
    with pytest.raises(ValueError):
        bpe.Vocabulary.build([b"a", b"a"])
    with pytest.raises(ValueError):
        bpe.Vocabulary.build([b"a", b"b"]).bytes_of(b"c")


def test_encoding_round_trip_with_odd_rows(spark):
    tokens, pattern, plain = library()
    table = docs(spark, ODD + [(100 + i, "s", t) for i, t in enumerate(odd_texts())])
    coded = bpe.encode(table, tokens, pattern)
    assert coded.columns == [c for c in table.columns if c != "ids"] + ["ids"] and coded.count() == table.count()
    for r in bpe.decode(coded, tokens).select("text", "ids", "decoded", bpe.unpacked(F.col("ids")).alias("list")).collect():
        want = plain.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "") and r.list == want and bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in want)
    nulls = spark.createDataFrame([(None,)], "ids binary")
    assert bytes(bpe.decode(nulls, tokens).first().decoded) == b"" and bpe.encode(table.limit(0), tokens, pattern).count() == 0


# operator 13


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """(root, proofs): proofs are lists of (before, after) by node."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for leaf, n in enumerate(at):
            run = runs[n // 3]
            proofs[leaf].append(("".join(run[: n % 3]), "".join(run[n % 3 + 1 :])))
        at, nodes = [n // 3 for n in at], [sha(*run) for run in runs]
    return (nodes[0] if nodes else None), proofs


def plain_manifest(rows):
    """Sorted rows of the query for rows of (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha(*map(field, r))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *plain_tree([leaf(r) for r in own])))
    root, upper = plain_tree([t[1] for t in trees])
    out = []
    for (own, subroot, proofs), top in zip(trees, upper):
        for r, proof in zip(own, proofs):
            d = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                d = leaf((*r[:4], r[4].replace("\n", "")))
            for before, after in proof + top:
                d = sha(before, d, after)
            out.append((r[0] if r[0] is not None else -99, leaf(r), subroot, root, sha(*(b + a for b, a in proof + top)), d, d == root))
    return sorted(out)


def manifest_rows(spark, table, monkeypatch):
    monkeypatch.setattr(merkle, "read", lambda *_: table)
    return sorted((r[0] if r[0] is not None else -99, *r[1:]) for r in merkle.op13_merkle_manifest(spark, SF).collect())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 28, 100])
def test_manifest_matches_plain_trees(spark, monkeypatch, n):
    rng = random.Random(n)
    rows = [(rng.randrange(10**6), rng.choice(["a", "b", "a/ä", None, ""]) if n > 3 else "s", "line\n" * rng.randrange(3)) for _ in range(n)]
    table = docs(spark, rows)
    assert manifest_rows(spark, table, monkeypatch) == plain_manifest([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in table.collect()])


def test_manifest_of_odd_rows_and_a_hot_group(spark, monkeypatch):
    rows = ODD + [(5000 + i, "hot", f"text {i}\n") for i in range(500)] + [(77, "hot", "same\n")] * 30
    table = docs(spark, rows).repartition(7)
    got = manifest_rows(spark, table, monkeypatch)
    assert got == plain_manifest([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in table.collect()])
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_line_dedup_of_crowded_buckets_is_whole(spark):
    """Similar lines that share one crowded bucket alone, with neither of its centres, are linked."""
    from loomspark.llm import linededup

    rng = random.Random(1)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head, tails = letters(66), [letters(18) for _ in range(1500)]
    lines = [x for t in tails for x in (head + t, head + t[:7] + letters(4) + t[11:])]
    table = lambda rows: linededup.occurrences(spark.createDataFrame(rows, "doc_id long, text string"))
    found = table(list(enumerate(lines)))
    keys = F.array(*[linededup.band_key(k) for k in range(len(linededup.BANDS))])
    minima = F.array(*[linededup._minimum(j) for j in range(linededup.BINS)])
    rows = linededup.signatures(found).join(found, "line").select("doc_id", keys.alias("keys"), minima.alias("minima")).collect()
    of = {r.doc_id: (set(r["keys"]), r["minima"]) for r in rows}
    held = {}
    for i, (own, _) in of.items():
        for key in own:
            held.setdefault(key, set()).add(i)
    pairs, kept = [], set()
    for i in range(0, len(lines), 2):
        shared = of[i][0] & of[i + 1][0]
        agree = sum(x == y for x, y in zip(of[i][1], of[i + 1][1]))
        x, y = ({lines[k][j : j + 5] for j in range(80)} for k in (i, i + 1))
        others = {k for key in shared for k in held[key] if k % 2 == 0} - {i}
        if len(shared) == 1 and agree >= linededup.AGREE and len(x & y) >= 0.8 * len(x | y) and len(others) > 20:
            pairs.append((i, i + 1))
            kept |= {i, i + 1} | set(sorted(others)[:30])
    assert pairs
    pairs = [(a, b) for a, b in pairs if a in kept and b in kept]
    found = table([(i, lines[i]) for i in sorted(kept)])
    groups = {r.doc_id: r.component for r in found.join(linededup.duplicate_groups(found), "line").collect()}
    assert [p for p in pairs if groups.get(p[0], p[0]) != groups.get(p[1], p[1])] == []


def test_line_dedup_joins_each_crowded_pair_once(spark):
    """cross_pairs() makes every pair of two components that agrees and is similar, once, and none of one component."""
    from loomspark.llm import linededup

    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    base = letters(200)
    edited = lambda x, n: "".join(rng.choice("abcdefghij") if i in places else c for places in [set(rng.sample(range(len(x)), n))] for i, c in enumerate(x))
    texts = [edited(base, n) for n in (1, 2, 3, 4, 6, 8, 10, 12) for _ in range(12)] + [letters(150) for _ in range(30)]
    found = linededup.occurrences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    lines = linededup.signatures(found).cache()
    comp = {r.line: r.doc_id % 3 for r in found.collect()}
    mixed = spark.createDataFrame(list(comp.items()), "line long, comp long")
    got = [tuple(r) for r in linededup.cross_pairs(found.select("line", "norm"), lines, mixed, 0.8).collect()]
    assert len(got) == len(set(got)) and all(a < b and comp[a] != comp[b] for a, b in got)
    sets = {r.line: {r.norm[i : i + 5] for i in range(len(r.norm) - 4)} for r in found.collect()}
    minima = {r.line: r.m for r in lines.select("line", F.array(*[linededup._minimum(j) for j in range(linededup.BINS)]).alias("m")).collect()}
    agree = lambda a, b: sum(x == y for x, y in zip(minima[a], minima[b])) >= linededup.AGREE
    want = {(a, b) for a in comp for b in comp if a < b and comp[a] != comp[b] and agree(a, b) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(want) > 100 and want <= set(got) and all(agree(a, b) for a, b in got)


def test_written_tables_leave_no_shuffle_files(spark):
    import glob
    import time

    from loomspark.llm import common

    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    files = lambda: set(glob.glob(f"{folder}/**/shuffle_*", recursive=True))
    before = files()
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert common.settle(rows).count() == common.stash(rows, "x").count() == 7
    for _ in range(20):  # they are removed in the background
        if left := {x for x in files() - before if x.endswith(".data")}:
            time.sleep(0.5)
    assert len(left) <= 2 and spark.conf.get(common.CLEANUP) == "false"  # the two counts' own
