"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

from pyspark.sql import functions as F

from trackweave.llm import manifest

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def tree(digests):
    """The root, and for each leaf the siblings from the leaf up."""
    proofs, nodes = [[] for _ in digests], list(digests)
    owners = [[i] for i in range(len(digests))]
    while len(nodes) > 1:
        up, above = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for k in range(len(run)):
                for i in owners[a + k]:
                    proofs[i] += run[:k] + run[k + 1 :]
            up.append(sha("".join(run)))
            above.append(sum(owners[a : a + 8], []))
        nodes, owners = up, above
    return nodes[0] if nodes else None, proofs


def brute(rows):
    """(doc_id, leaf, subroot, root, proof digest, does it verify) by document."""
    leaf = lambda r, text: sha("".join(map(code, (r[0], r[1], r[2], r[3], text))))
    groups = {}
    for r in rows:
        changed = r[4]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
            changed = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), changed == r[4]))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    found = {k: tree([x[2] for x in sorted(groups[k])]) for k in keys}
    root, upper = tree([found[k][0] for k in keys])
    out = []
    for k, above in zip(keys, upper, strict=True):
        for (known, i, digest, same), own in zip(sorted(groups[k]), found[k][1], strict=True):
            out.append((i if known else None, digest, found[k][0], root, sha("".join(own + above)), same))
    return out


def rows():
    odd = [(None, None, None, None, None), (None, "s", "en", 3, "Ab"), (7, "s", "", 0, ""), (8, "s", "zz", 1, "Ä" * 200_000), (9, None, "é", 5, "Q\n-1:x")]
    many = [(i * 7 % 1000, f"s{i % 3}", ["en", "de", "fr", "es", "it", "pt", "nl", "pl", "cs"][i % 11 % 9], i, f"Text {i % 50}") for i in range(700)]
    return odd + many + many[:5] + [many[1]] * 90


def key(r):
    return (r[0] is not None, r[0] or 0, *map(str, r[1:]))


def test_query_against_a_plain_tree(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in manifest.op11_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(found, key=key) == sorted(brute(rows()), key=key)


def test_small_tables(spark, tmp_path):
    for n in (0, 1, 2, 9):
        part = rows()[:n]
        spark.createDataFrame(part, SCHEMA).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        found = manifest.op11_merkle_manifest(spark, f"{tmp_path}/{n}").collect()
        assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in found), key=key) == sorted(brute(part), key=key)


def test_other_columns_and_clashes(spark):
    df = spark.createDataFrame([("b", 1, "x"), ("a", 1, None), ("a", 2, "y")], "group string, place int, digest string")
    out = manifest.proved(df, manifest.leaf_digest(F.col("place"), F.col("digest")), group="group", order=("place",), keep=("group", "place", "digest")).collect()
    assert sorted((r.group, r.place, r.digest or "") for r in out) == [("a", 1, ""), ("a", 2, "y"), ("b", 1, "x")]
    assert len({r.root for r in out}) == 1
    for r in out:
        digest = r.leaf
        for step in r.proof:
            digest = sha("".join(step.siblings[: step.place] + [digest] + step.siblings[step.place :]))
        assert digest == r.root
    try:
        manifest.proved(df.withColumnRenamed("place", "leaf"), F.lit("x"), group="group", order=("leaf",), keep=("leaf",))
    except ValueError as refused:
        assert "leaf" in str(refused)
    else:
        raise AssertionError
