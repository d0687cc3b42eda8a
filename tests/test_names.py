from domainsieve.operators import names as nm
from domainsieve.operators.names import TailIndex
from domainsieve.registry.inputs import index as sample_index
from domainsieve.sources.text import parse_suffix_rules


def keyed(names, index, *domains):
    return {r["domain"]: r for r in nm.with_name_keys(names(*domains), index).collect()}


def test_apex_follows_suffix_rules(names, index):
    got = keyed(names, index, "deep.harbour.co.in", "www.lake.co.uk", "files.meadow.com", "rough.com",
                "x.y.zq", "z.www.zq", "a.town.kiwi.nz", "b.a.inn.kiwi.nz", "co.uk", "single",
                "a.b.unlisted", "10.7.8.9")
    apex = {d: r["apex"] for d, r in got.items()}
    assert apex == {
        "deep.harbour.co.in": "harbour.co.in", "www.lake.co.uk": "lake.co.uk",
        "files.meadow.com": "meadow.com", "rough.com": "rough.com", "x.y.zq": "x.y.zq",
        "z.www.zq": "www.zq", "a.town.kiwi.nz": "town.kiwi.nz",
        "b.a.inn.kiwi.nz": "a.inn.kiwi.nz", "co.uk": "co.uk", "single": "single",
        "a.b.unlisted": "b.unlisted", "10.7.8.9": "8.9"}
    assert got["deep.harbour.co.in"]["host_label"] == "harbour"
    assert got["www.lake.co.uk"]["host_label"] == "lake"
    assert got["a.b.unlisted"]["host_label"] == "unlisted"
    assert got["10.7.8.9"]["host_label"] == "10.7.8.9"


def test_private_rules_and_providers(names, index):
    got = keyed(names, index, "a.rough.github.io", "my-shop.github.io", "fake-bank.sites.demo",
                "github.io", "mygithub.io", "www.meadow.com", "c.a.b.tenant-cloud.com", "site.weebly.com")
    assert got["a.rough.github.io"]["private_apex"] == "rough.github.io"
    assert got["a.rough.github.io"]["apex"] == "github.io"
    assert got["my-shop.github.io"]["host_label"] == "my-shop"
    assert got["my-shop.github.io"]["icann_label"] == "github"
    assert got["fake-bank.sites.demo"]["host_label"] == "fake-bank"
    assert got["github.io"]["private_apex"] == "github.io"
    assert got["c.a.b.tenant-cloud.com"]["private_apex"] == "a.b.tenant-cloud.com"
    provider = {d: r["provider"] for d, r in got.items()}
    assert provider == {
        "a.rough.github.io": "github.io", "my-shop.github.io": "github.io",
        "fake-bank.sites.demo": "sites.demo", "github.io": "github.io", "mygithub.io": None,
        "www.meadow.com": None, "c.a.b.tenant-cloud.com": "tenant-cloud.com", "site.weebly.com": "weebly.com"}


def test_measured_index_equals_literal_index(spark, names, index):
    from domainsieve.functions.literals import literal_table
    from domainsieve.registry.inputs import hosting_rows, rule_rows
    rules = literal_table(spark, rule_rows(),
                          "suffix string, section string, is_wildcard boolean, is_exception boolean")
    hosting = literal_table(spark, [(h,) for h in hosting_rows()], "suffix string")
    measured = nm.suffix_index(rules, hosting)
    assert measured.depth == index.depth
    d = names("a.b.c.co.uk", "x.github.io", "q.www.zq")
    assert (sorted(nm.with_name_keys(d, measured).collect())
            == sorted(nm.with_name_keys(d, index).collect()))


def test_keys_need_no_shuffle(spark, names, index):
    plan = nm.with_name_keys(names("a.com"), index)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_hosting_suffixes_fall_back_and_merge(spark):
    snapshot = spark.createDataFrame([("rooms.demo",)], "suffix string")
    fallback = spark.createDataFrame([("github.io",)], "suffix string")
    got = {r[0] for r in nm.hosting_suffixes(snapshot, fallback, (".Sites.Demo",)).collect()}
    assert got == {"rooms.demo", "sites.demo"}
    got = {r[0] for r in nm.hosting_suffixes(snapshot.limit(0), fallback, ()).collect()}
    assert got == {"github.io"}


def test_rules_give_private_suffixes(spark):
    lines = ["// ===BEGIN ICANN DOMAINS===", "nz", "рф", "// ===END ICANN DOMAINS===", "",
             "// ===BEGIN PRIVATE DOMAINS===", "Sites.Demo", "*.rooms.demo", "!hall.rooms.demo", "// a remark",
             "blogs.sample-host.net", "// ===END PRIVATE DOMAINS===", "later.demo"]
    d = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    rules = parse_suffix_rules(d)
    private = {r[0] for r in nm.private_suffixes(rules).collect()}
    assert private == {"blogs.sample-host.net", "sites.demo", "rooms.demo"}
    icann = {r[0] for r in rules.filter("section = 'icann'").collect()}
    assert icann == {"nz", "рф", "xn--p1ai"}


def test_large_tables_give_the_same_keys(spark, index, names):
    d = names("www.a.co.uk", "x.github.io", "b.tenant-cloud.com", "c.a.b.tenant-cloud.com", "town.kiwi.nz", "x.y.kiwi.nz",
              "10.0.0.1", "single", "deep.er.than.any.rule.com", *[f"n{i}.com" for i in range(50)])
    large = TailIndex(index.table.hint("merge"), index.depth, large=True)
    rows = (lambda i: sorted(map(str, nm.with_name_keys(d, i).collect())))
    assert rows(large) == rows(index)
