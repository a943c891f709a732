import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import mixing, packing, quality, secrets, warc
from driftwell.llm._util import shared_dir

SF = "/root/testdata/sf0.01"


def test_quality_on_the_held_out_fold(spark):
    out = quality.op9_quality(spark, SF).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(out) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    good = [r.score for r in out if r.held_out and label.get(r.doc_id) == 1]
    bad = [r.score for r in out if r.held_out and label.get(r.doc_id) == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([g >= 0.3 for g in good]) > 0.97


def test_quality_edge_cases(spark):
    rows = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "x!! " * 30000, 3), (2, "", 2)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.scored(rows, quality.fit_quality(rows, labels)).collect()
    assert len(out) == 4 and {r.score for r in out} == {0.5}
    assert quality.keep_good(rows, quality.fit([])).columns == rows.columns
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert quality.scored(docs, quality.fit([])).count() == 0


def test_mixing_meets_targets(spark):
    out = mixing.op8_mixing(spark, SF)
    names = [f"p_{d}" for d in mixing.DOMAINS]
    natural = out.agg(*[F.sum(F.col("n_tokens") * F.col(p)) for p in names]).first()
    got = out.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col(p)) for p in names]).first()
    want = mixing.targets_for(list(natural), mixing.DOMAINS, mixing.TARGETS, mixing.ANCHOR, mixing.ANCHOR_RATE)
    assert np.allclose(list(got), want, rtol=1e-4)
    low, high = out.agg(F.min("rate"), F.max("rate")).first()
    assert 0 <= low <= high
    assert out.filter(F.abs(F.col("copies") - F.col("rate")) >= 1).count() == 0


def test_rates_reach_any_feasible_target(spark):
    r = np.random.default_rng(0)
    n, p = r.integers(1, 100, 200), r.dirichlet((1, 1, 0.1), 200)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n long, p array<double>")

    def fitted(goal, most=None):
        out = members.withColumn("r", mixing.rate("p", mixing.fit_rates(members, goal, most), most)).collect()
        rate = np.array([x.r for x in out])
        return rate, sum(x.r * x.n * np.array(x.p) for x in out)

    natural = (n[:, None] * p).sum(0)
    for factors in ((1.3, 0.5, 1.0), (0.2, 3.0, 1.0), (1.0, 1.0, 9.0)):
        goal = (natural * factors).tolist()
        rate, got = fitted(goal)
        # The least residual over nonnegative rates, found by a solver of another kind.
        x = packing.nnls((n[:, None] * p).T.astype(float), np.array(goal))
        assert rate.min() >= 0 and np.linalg.norm(got - goal) <= np.linalg.norm((n[:, None] * p).T @ x - goal) + 1e-3 * sum(goal)
    rate, _ = fitted((natural * (1.0, 1.0, 50.0)).tolist(), most=4.0)
    assert rate.max() <= 4


def test_posteriors_tell_domains_apart(spark):
    out = {x.doc_id: x for x in mixing.op8_mixing(spark, SF).collect()}
    rows = [x for x in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(x.doc_id).encode()) % 5 == 0 and x.doc_id in out]
    want = ["toxic" if x.toxic == 1 else "junk" if x.quality == 0 else "clean" for x in rows]
    got = [max(mixing.DOMAINS, key=lambda d: out[x.doc_id][f"p_{d}"]) for x in rows]
    assert np.mean([a == b for a, b in zip(want, got, strict=True)]) > 0.85  # some 320 labels to learn from


def test_mixing_edge_cases(spark):
    rows = spark.createDataFrame([(1, None, 1), (1, None, 1), (None, "a b", 2)], "doc_id long, text string, rate int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mixing_rates(rows, labels).count() == 3
    assert mixing.mix(rows, labels).columns == rows.columns
    assert mixing.mixing_rates(rows.limit(0), labels).count() == 0


def test_secret_scan(spark):
    r = random.Random(5)
    keys = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(20)]
    rows = [(i, f'some words token = "{k}" and more') for i, k in enumerate(keys)]
    rows += [(100, f"commit {keys[0]} fixed"), (101, "card 4929348385146306 used"), (102, 'token = "xxxxxxxxxxxxxxxxxxxx1"'), (103, None), (104, ""), (105, "id 123e4567-e89b-12d3-a456-426614174000.")]
    rows += [(106, "a\x01b " + f'SECRET = "{keys[1].upper()}"'), (None, f'api_key: "{keys[2]}"'), (0, rows[0][1])]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, score int")
    out = secrets.scan(docs, secrets.fit_forest(spark, secrets.example_findings())).collect()
    found = {(x.doc_id, x.candidate) for x in out if x.is_secret}
    assert {(i, k) for i, k in enumerate(keys)} <= found and (106, keys[1].upper()) in found and (None, keys[2]) in found
    assert not {x for x in found if x[0] in (100, 101, 102, 105)}
    assert len(out) == len(keys) + 1 + 4 + 2
    assert secrets.scan(docs.limit(0), [0.5]).count() == 0
    long = spark.createDataFrame([(1, "word " * 200_000 + f'token = "{keys[3]}"')], "doc_id long, text string")
    assert [x.candidate for x in secrets.scan(long, [0.5]).collect()] == [keys[3]]


def test_warc_round_trip(spark):
    rows = [(1, "u v", "a"), (2, None, "a"), (3, "u", None), (4, None, ""), (4, None, ""), (None, "x", "a"), (None, "y", "zz"), (5, "http://x/é\n", "<é>" * 9000)]
    pages = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, marks int")
    folder = shared_dir(spark, "test")
    manifest = warc.write_archives(pages, folder, roll=200)
    assert sum(m["records"] for m in manifest) == len(rows)
    out = warc.read_archives(spark, folder).collect()
    assert sorted(repr((x.page_id, x.record_type, x.refers_to)) for x in out) == sorted(
        map(repr, [(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (4, "revisit", 4), (None, "revisit", 2), (None, "response", None), (5, "response", None)])
    )
    body = rows[-1][2].encode()
    last = next(x for x in out if x.page_id == 5)
    assert (last.payload_bytes, last.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
    again = shared_dir(spark, "test")
    assert warc.write_archives(pages, again, roll=200) == manifest
    empty = shared_dir(spark, "test")
    assert warc.write_archives(pages.limit(0), empty) == [] and warc.read_archives(spark, empty).count() == 0


def test_warc_pages_without_id_are_spread(spark):
    """Half of all pages have no id, and most of those agree in url and payload: every record is there, in many ranges."""
    body = "same " * 40
    rows = [(None, None, body)] * 700 + [(None, f"u{i}", body) for i in range(150)] + [(None, f"v{i}", f"own {i} " * 30) for i in range(150)]
    rows += [(i, f"w{i}", body if i % 3 == 0 else f"page {i} " * 30) for i in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    folder = shared_dir(spark, "test")
    manifest = warc.write_archives(pages, folder, range_bytes=10_000)
    ranges = collections.Counter()
    for m in manifest:
        ranges[m["name"][:11]] += m["records"]
    _, nameless = warc.borders(pages, 10_000)
    first = [ranges.get(f"part-{i:06d}", 0) for i in range(nameless)]
    assert nameless > 10 and sum(first) == 1000 and max(first) < 500 and sum(ranges.values()) == len(rows)
    got = collections.Counter((x.page_id, x.payload_digest, x.record_type, x.refers_to) for x in warc.read_archives(spark, folder).collect())
    keeper = {}
    for page_id, _, html in rows:
        if page_id is not None:
            keeper[html] = max(page_id, keeper.get(html, -1))
    want = collections.Counter()
    for page_id, _, html in rows:
        of = keeper.get(html)
        revisit = of is not None and of != page_id
        want[page_id, warc.sha1_base32(html.encode()), "revisit" if revisit else "response", of if revisit else None] += 1
    assert got == want
    again = shared_dir(spark, "test")
    assert warc.write_archives(pages.repartition(3), again, range_bytes=10_000) == manifest


def test_secrets_in_texts_of_common_formats(spark):
    """Whole texts, where training has findings cut out by rule.

    No held-out measure: the rules make findings of the same families, and those of assigned digests were added when
    this test showed them as false positives.
    """
    r = random.Random(12)

    def draw(chars, n):
        return "".join(r.choice(chars) for _ in range(n))

    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    every, hexa = low + up + num, "0123456789abcdef"
    yes, no = [], []
    for _ in range(25):
        yes += [
            (f"AWS_ACCESS_KEY_ID=AKIA{(k := draw(up + num, 16))}", f"AKIA{k}"),
            (f"Please rotate ghp_{(k := draw(every, 36))} before Monday.", f"ghp_{k}"),
            (f"DATABASE_URL=postgres://app:{(k := draw(every, 18))}@db.internal:5432/main", k),
            (f"curl -H 'Authorization: Bearer {(k := draw(every, 40))}' https://api.shop.test", k),
            (f'{{"clientSecret": "{(k := draw(every, 32))}", "region": "eu"}}', k),
            (f"db_password: '{(k := 'Blue' + draw('!#%&', 1) + draw(num, 4) + draw(low, 3))}'", k),
            (f"the signed cookie eyJ{(k := draw(every, 20) + '.' + draw(every, 40) + '.' + draw(every, 43))} leaked", f"eyJ{k}"),
            (f"private_key = {(k := draw(low + up, 32))}", k),
        ]
        u = "-".join(draw(hexa, n) for n in (8, 4, 4, 4, 12))
        no += [
            f"token id: {u}",
            f"Merge commit {draw(hexa, 40)} into main",
            f'ETag: "{draw(hexa, 32)}"',
            f"see https://cdn.shop.test/assets/{draw(low, 6)}/{draw(num, 8)}-{draw(low, 9)}.jpg for it",
            f'"integrity": "sha512-{draw(every, 86)}=="',
            f"request {u} took 13 ms",
            "password: required field of the form",
            "API_KEY=${API_KEY} docker compose up",
            f"order {draw(num, 18)} was shipped",
            "Your token: documentation explains everything",
        ]
    rows = [(i, t) for i, (t, _) in enumerate(yes)] + [(1000 + i, t) for i, t in enumerate(no)]
    out = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), secrets.fit_forest(spark, secrets.example_findings())).collect()
    found = {(x.doc_id, x.candidate) for x in out if x.is_secret}
    recall = np.mean([(i, k) in found for i, (_, k) in enumerate(yes)])
    wrong = len({i for i, _ in found if i >= 1000}) / len(no)
    by_kind = [np.mean([(i, k) in found for i, (_, k) in list(enumerate(yes))[j::8]]) for j in range(8)]
    assert recall >= 0.9 and min(by_kind) >= 0.6 and wrong <= 0.05, (by_kind, wrong, {t[:60] for i, t in rows if i >= 1000 and i in {f[0] for f in found}})


def test_archives_do_not_depend_on_tasks(spark):
    r = random.Random(2)
    rows = [(i if i % 50 else None, f"http://x/{i}", r.choice(["same", "<p>" * r.randint(0, 60) + str(i)])) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = []
    for parts in (3, 9):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        folder = shared_dir(spark, "test")
        manifest = warc.write_archives(pages.repartition(parts), folder, roll=3000, range_bytes=2000)
        files, root = warc.pafs.FileSystem.from_uri(folder)
        made.append([(m["name"], files.open_input_stream(f"{root}/{m['name']}", compression=None).read()) for m in manifest])
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert made[0] == made[1] and len(made[0]) > 5
    ids = [x.page_id for x in warc.read_archives(spark, folder).collect()]
    assert sorted(map(str, ids)) == sorted(str(x[0]) for x in rows)


def test_warc_query_equals_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    keeper = {}
    for x in pages:
        keeper[x.html or ""] = max(keeper.get(x.html or "", -1), x.page_id)
    want = []
    for x in pages:
        body, keep = (x.html or "").encode(), keeper[x.html or ""]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((x.page_id, len(body), digest, "response" if keep == x.page_id else "revisit", None if keep == x.page_id else keep))
    assert sorted(map(tuple, warc.op6_warc(spark, SF).collect())) == sorted(want)


def test_damaged_records_are_refused():
    record = zlib.decompress(warc.page_record(1, "u", b"payload", None), 31)
    assert warc.page_of(record)[1:4] == (7, warc.sha1_base32(b"payload"), "response")
    with pytest.raises(ValueError):
        warc.page_of(record.replace(b"payload\r\n\r\n", b"payloaf\r\n\r\n"))


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline
    from driftwell.llm._util import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, sizes = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "test")
        assert docs.columns == names
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] and sizes[4] >= 0.9 * sizes[3]
    text = docs.groupBy("text").agg(F.count_distinct("doc_id").alias("n"))
    assert text.filter("n > 1").count() == 0
    pieces = corpus_pipeline.packed(spark, docs, SF)
    tokens = docs.count(), pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert tokens[1].filter("n <> end or n > 4096").count() == 0
