"""Registered queries over all their rows, against plain Python."""

import unicodedata

from namewright.operators import resolve
from namewright.plans import catalog, contacts

DATA = "/root/testdata/sf0.001"


def ratio(a, b):
    old = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(old[j] + 1 if x == y else max(old[j + 1], new[j]))
        old = new
    return 200.0 * old[-1] / (len(a) + len(b)) if a or b else 100.0


def test_match_cache_has_all_firms(spark):
    canonical = resolve.canonical_firms(contacts.clean(spark, DATA)).collect()
    firms = {r.firm: r.domain for r in canonical}
    rows = catalog.QUERIES["match_cache"](spark, DATA).collect()
    assert {r.canonical_firm for r in rows} == set(firms) and len({r.raw_firm for r in rows}) == len(rows)
    key = lambda x: " ".join(sorted(x.lower().split()))
    for r in sorted(rows, key=lambda r: r.raw_firm)[::20]:
        exact = [f for f in firms if f.lower() == r.raw_firm.lower()]
        best = (100.0, min(exact)) if exact else min(((ratio(key(r.raw_firm), key(f)), f) for f in firms), key=lambda x: (-x[0], x[1]))
        assert (r.canonical_firm, r.domain) == (best[1], firms[best[1]]) and abs(r.match_score - best[0]) < 1e-9


def test_firm_site_ratio_of_all_contacts(spark):
    rows = contacts.contacts(spark, DATA).collect()
    want = {r.id: round(ratio(r.firm, r.website.split("//WWW.")[1].split("/")[0]), 6) for r in rows}
    got = catalog.QUERIES["firm_site_ratio"](spark, DATA).collect()
    assert len(got) == len(rows) and all(abs(r.score - want[r.id]) < 1e-6 for r in got)


def test_nfkd_of_whole_documents(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = {r.doc_id: r.plain for r in catalog.QUERIES["nfkd_documents"](spark, DATA).collect()}
    plain = lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()
    assert got == {r.doc_id: None if r.text is None else plain(r.text) for r in rows}
