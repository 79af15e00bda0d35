"""The operators' registered queries, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import bpe, decontaminate, digest, fim, id_store, ngram_join, quality, shards, suffix_dedup, token_count, toxicity, url_filter, whitening
from .columns import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


RULES = [url_filter.Rule("org/", "allow"), url_filter.Rule("example.org/es/", "block"), url_filter.Rule("example.org/en/1", "block"),
         url_filter.Rule("com/fr/", "allow"), url_filter.Rule("com/de/", "block")]
#: The small labelled URL table: kinds of unwanted site, and words and names of harmless ones, many of which hold an unwanted one inside.
UNWANTED = {
    "gambling": ["casino", "casinos", "poker", "roulette", "slots", "jackpot", "bet", "bets", "betting", "gambling", "blackjack", "bingo", "baccarat", "lottery", "wager"],
    "adult": ["adult", "porn", "xxx", "nude", "nudes", "escort", "sex", "camgirls", "erotic", "hentai", "milf", "strip"],
    "pills": ["pills", "viagra", "cialis", "pharma", "steroids", "painkiller", "xanax", "valium", "dietpills"],
    "fraud": ["spam", "scam", "phishing", "malware", "warez", "crack", "keygen", "torrent", "fakeid", "cheapwatches", "getrich", "ponzi"],
}
HARMLESS = {
    "words": ["news", "blog", "wiki", "docs", "school", "library", "museum", "science", "weather", "recipes", "forum", "travel", "garden", "music", "history",
              "health", "hospital", "university", "football", "photography", "knitting", "bakery", "plumber", "lawyer", "dentist", "cinema", "theatre", "maps"],
    "inside": ["alphabet", "better", "betty", "tibet", "elizabeth", "pillow", "pillar", "pillsbury", "sports", "airports", "passport", "transport", "essex", "sussex", "adulthood",
               "stripes", "cracker", "nutcracker", "peppercorn", "popcorn", "slotcar", "bingley", "escorial", "lotte", "torrens", "spanish", "scampi", "camden", "pharmacist", "cassius"],
    "names": ["anderson", "brookfield", "castello", "dunmore", "ellery", "fairhaven", "gruber", "hawthorne", "iverson", "jansen", "keller", "lindholm", "moreau", "norwood",
              "olivera", "petersen", "quintero", "rothman", "sandoval", "tremont", "underhill", "vasquez", "whitmore", "yardley", "lakeside", "riverton", "hillcrest", "maplewood",
              "sterling", "fielding", "northgate", "eastbrook", "kowalski", "nakamura", "fernandez", "okafor", "lefebvre", "rossi", "schmidt", "novak", "thornbury", "athens"],
}
#: Forms of a site's name; both labels have all of them.
FORMS = ["{}", "best-{}", "{}-online", "free-{}", "{}24", "my{}", "the-{}-site", "{}-club", "lucky-{}"]
DOMAINS, LANGUAGES = ("com", "net", "org"), ("en", "de", "fr", "es")


def labelled_names() -> list[tuple[str, int, list[str]]]:
    """(name, label, hosts): a site's name, whether it is unwanted, and its hosts in some of the forms."""
    out = []
    for label, table_of, forms in ((1, UNWANTED, 6), (0, HARMLESS, 3)):
        names = [n for some in table_of.values() for n in some]
        out += [(n, label, [FORMS[(k * 4 + j * (9 // forms)) % 9].format(n) for j in range(forms)]) for k, n in enumerate(names)]
    return out


def labelled_urls(spark: SparkSession, names: list[tuple[str, int, list[str]]] | None = None) -> DataFrame:
    """Labels depend on the kind of site alone: either label has the same domains, language paths, prefixes and page names."""
    tails = [(end, lang) for end in DOMAINS for lang in LANGUAGES]
    rows = []
    for label in (0, 1):
        hosts = [h for _, y, some in names or labelled_names() if y == label for h in some]
        for k, host in enumerate(hosts):
            # Every host has a third of the tails, and every tail as many hosts.
            rows += [(f"https://{('', 'www.', 'm.', 'blog.')[(k + t) % 4]}{host}.example.{end}/{lang}/{7 + (37 * k + 101 * t) % 1990}", label)
                     for t, (end, lang) in enumerate(tails) if t % 3 == k % 3]
    return spark.createDataFrame(rows, "url string, label int")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(labelled_urls(spark))
    return url_filter.judge_urls(pages, RULES, model).select("page_id", "host", "path", "rule", "verdict", "block_probability")


def op2_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return id_store.read_back(spark, id_store.write_ids(docs, tokenizer_path("byte_bpe_50k.json")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, tokenizer_path("piece_bpe_32k.model")).drop("text")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shards.with_slots(table(spark, sf_dir, "documents").select("doc_id", "text"))
    placed = shards.assign_slotted(docs.drop("text"), 40, grown=41)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
                         F.col("grown_shard").alias("rebalanced_shard"), "virtual_slot")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, tokenizer_path("byte_bpe_50k.json")).drop("text")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.FactorizationMachine:
    """Trained on labelled documents outside the held-out fold (crc32 of the id, modulo 5, is 0)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    return toxicity.train_joined(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity_model(spark, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).drop("text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.judge(docs, quality.log_ratios(docs, trusted)).drop("text")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.with_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors, whitening.fit(vectors))


_BUILDERS = [op1_url_filter, op2_id_store, op3_decontamination, op4_token_counts, op5_sharding, op6_bpe, op7_toxicity, op8_ngram_join, op9_suffix_dedup, op10_quality,
             op11_fingerprints, op12_fill_in_middle, op13_whitening]


def _run(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(configure(spark), sf_dir)


QUERIES = {b.__name__: _run(b) for b in _BUILDERS}
#: The other operators' models, hashes and tokenizers have no SQL; tests compare them with brute force.
ORACLES: dict[str, str] = {"op12_fill_in_middle": fim.SQL}
