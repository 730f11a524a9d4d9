import duckdb
import numpy as np
import pytest

from flowlens.llm.url_filter import OP4_SQL, Reputation, above, op4_url_filter, url_filter


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, verdict string")


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "id long, bad int")


def test_hosts_and_rules(spark):
    urls = ["http://A.Example.NET/en/x?q=1", "https://example.net", "https://x.net/#t", "http://notexample.com/de/1", "http://www.EXAMPLE.com/de/#x", "http://a.org/fr/", "http://a.org/FR/", None, "no scheme.net/", "x://y://z.net/a", "http://b.org?/fr/", "http://c.org:80/fr/q/"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(pages(spark, urls), outcomes(spark, [])).collect()}
    assert got == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.net", "", None, "allow"), 2: ("x.net", "/", "net/", "block"), 3: ("notexample.com", "/de/1", None, "allow"), 4: ("www.example.com", "/de/", "example.com/de/", "block"),
        5: ("a.org", "/fr/", "org/fr/", "allow"), 6: ("a.org", "/FR/", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("y:", "//z.net/a", None, "allow"), 10: ("b.org", "", None, "allow"), 11: ("c.org:80", "/fr/q/", None, "allow"),
    }


def test_bad_hosts_are_blocked_and_thin_evidence_is_not(spark):
    urls = [f"http://bad.one.xyz/{k}" for k in range(60)] + [f"http://good{k % 5}.two.xyz/{k}" for k in range(200)] + ["http://thin.three.xyz/1", "http://unseen.one.xyz/"]
    rows = [(k, 1) for k in range(60)] + [(60 + k, 0) for k in range(200)] + [(260, 1), (None, 1), (5, None)]
    got = url_filter(pages(spark, urls), outcomes(spark, rows)).collect()
    verdict = {r.host: r.verdict for r in got}
    assert verdict["bad.one.xyz"] == "block" and verdict["good1.two.xyz"] == "allow" and verdict["thin.three.xyz"] == "allow"
    mean = {r.host: r.bad_mean for r in got}
    assert mean["unseen.one.xyz"] > mean["good1.two.xyz"] and all(0 <= r.bad_prob <= 1 for r in got)


def test_repeated_rows_and_empty_tables(spark):
    p = pages(spark, ["http://a.xyz/"] * 3)
    assert url_filter(p.unionByName(p), outcomes(spark, [(0, 1), (0, 1)])).count() == 6
    assert url_filter(p.limit(0), outcomes(spark, [(0, 1)])).count() == 0


@pytest.mark.parametrize("host, domain", [("a.b.co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("a.b.com", "b.com"), ("com", "com"), ("", ""), ("10.1.2.3", "10.1.2.3"), ("a.example.com:8080", "example.com"), ("u:p@a.b.com.", "b.com"), ("[::1]:80", "[::1]"), ("x.y.co.za", "y.co.za"), ("shop.city.kawasaki.jp", "kawasaki.jp")])
def test_registered_domains(spark, host, domain):
    from pyspark.sql import functions as F

    from flowlens.llm.url_filter import suffix_and_domain

    assert spark.range(1).select(suffix_and_domain(F.lit(host), Reputation())[1]).first()[0] == domain


def test_given_suffixes(spark):
    from pyspark.sql import functions as F

    from flowlens.llm.url_filter import suffix_and_domain

    how = Reputation(suffixes=("github.io", "city.kawasaki.jp", "co.uk"))
    hosts = ["x.github.io", "a.x.github.io", "shop.b.city.kawasaki.jp", "a.b.org"]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(suffix_and_domain(F.col("h"), how)[1]).collect()]
    assert got == ["x.github.io", "x.github.io", "b.city.kawasaki.jp", "b.org"]


def test_tail_of_the_posterior():
    rng = np.random.default_rng(3)
    a, b = np.array([0.05, 0.5, 1.0, 2.5, 12.0, 300.0, 3.0]), np.array([0.3, 4.0, 1.0, 9.0, 8.0, 900.0, 2000.0])
    sampled = [(rng.beta(p, q, 400_000) > 0.2).mean() for p, q in zip(a, b)]
    assert np.allclose(above(a, b, 0.2), sampled, atol=4e-3)
    assert above(np.array([1.0]), np.array([1.0]), 0.2)[0] == pytest.approx(0.8) and above(np.array([0.0, 3.0]), np.array([2.0, 0.0]), 0.2).tolist() == [0, 1]


def test_query_blocks_planted_hosts_as_its_sql(spark, tmp_path):
    """Hosts without a rule: one bad through and through, a good neighbour, hosts of a bad domain without outcomes; very long urls."""
    rows, k = [], 0
    for host, n, bad in (("spam.evil.xyz", 40, 38), ("more.evil.xyz", 30, 27), ("calm.fine.xyz", 200, 6), ("other.fine.xyz", 60, 2), ("half.mixed.xyz", 4, 2), ("shop.b.co.uk:80", 20, 1)):
        for j in range(n):
            rows.append((k, f"http://{host}/{j}", int(j >= bad)))
            k += 1
    extra = [(k, "http://new.evil.xyz/"), (k + 1, None), (k + 2, "http://calm.fine.xyz/" + "x" * 200_000), (k + 3, "http://10.0.0.1/")]
    spark.createDataFrame([r[:2] for r in rows] + extra, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: (r.verdict, r.bad_mean, r.bad_prob) for r in op4_url_filter(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    expected = {r[0]: r[4:] for r in con.execute(OP4_SQL).fetchall()}
    assert got.keys() == expected.keys()
    for p in got:
        assert got[p][0] == expected[p][0] and got[p][1:] == pytest.approx(expected[p][1:], abs=2e-4)
    assert {got[r[0]][0] for r in rows if "evil" in r[1]} == {"block"} == {got[k][0]} and {got[r[0]][0] for r in rows if "fine" in r[1]} == {"allow"}
