"""The URL model learns the kind of site, not domain or language path."""

from collections import Counter

from pyspark.sql import functions as F

from logweir.llm import queries, url_filter

TAILS = [(end, lang) for end in queries.DOMAINS for lang in queries.LANGUAGES]


def test_labels_do_not_follow_domain_or_language(spark):
    rows = queries.labelled_urls(spark).collect()
    assert len(rows) == len(set(rows)) <= 4000
    for label in (0, 1):
        tails = Counter(tuple(r.url.split("example.")[1].split("/")[:2]) for r in rows if r.label == label)
        assert set(tails) == set(TAILS) and len(set(tails.values())) == 1


def test_op1_verdicts_follow_the_kind_of_site(spark, tmp_path):
    bad, good = ["lucky-casino", "free-bets", "spam-farm", "adult-fun"], ["lowell", "herriot", "brunswick", "chandler"]
    hosts = [(f"https://{prefix}{name}.example.{end}/{lang}/{n}", name) for name in bad + good for prefix in ("", "m.") for end, lang in TAILS for n in (61, 905)]
    # Ruled pages outnumber the labelled table, and none of them may teach the model.
    ruled = [(f"https://casino{i}.example.org/en/2{i}", "ruled") for i in range(1500)] + [(f"https://chandler{i}.example.com/de/{i}", "ruled") for i in range(1500)]
    df = spark.createDataFrame(hosts + ruled, "url string, name string").withColumn("page_id", F.monotonically_increasing_id()).select("page_id", "url", F.lit("").alias("html"))
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = [r for r in queries.QUERIES["op1_url_filter"](spark, str(tmp_path)).collect() if r.rule is None]
    assert len(got) > 100
    for r in got:
        assert r.verdict == ("block" if any(name in r.host for name in bad) else "allow"), r


def test_model_does_not_see_the_pages(spark, sf_dir):
    model = url_filter.train(queries.labelled_urls(spark))
    for r in queries.QUERIES["op1_url_filter"](spark, sf_dir).collect():
        assert abs(r.block_probability - model.block_probability([r.host], [r.path])[0]) < 1e-9


def test_rates_on_names_never_seen(spark):
    """Five folds by name: names of the judged fold, in any form, are not in the table the model is trained on."""
    names = queries.labelled_names()
    blocked, count = Counter(), Counter()
    for fold in range(5):
        model = url_filter.train(queries.labelled_urls(spark, [n for k, n in enumerate(names) if k % 5 != fold]))
        for name, label, hosts in names[fold::5]:
            p = model.block_probability([f"{h}.example.com" for h in hosts], ["/en/12"] * len(hosts))
            blocked[label] += int((p >= 0.5).sum())
            count[label] += len(hosts)
    false_block, miss = blocked[0] / count[0], 1 - blocked[1] / count[1]
    print(f"names never seen: false blocks {false_block:.3f}, misses {miss:.3f}")
    # A word whose letters were never seen cannot be known; what matters is that it is allowed, and few harmless ones are not.
    assert false_block < 0.1 and miss < 0.95


def test_words_with_an_unwanted_one_inside(spark):
    model = url_filter.train(queries.labelled_urls(spark))
    harmless = [n for some in queries.HARMLESS.values() for n in some]
    p = model.block_probability([f"{n}.example.com" for n in harmless], ["/en/12"] * len(harmless))
    assert (p < 0.5).all()
    unwanted = [n for some in queries.UNWANTED.values() for n in some]
    p = model.block_probability([f"{n}.example.net" for n in unwanted], ["/de/12"] * len(unwanted))
    assert (p >= 0.5).mean() > 0.95
