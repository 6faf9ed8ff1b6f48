"""Sources, cleaning and descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bind
from checks.bind import table
from checks.registry import query
from triptych.functions import cleaning, describing
from triptych.sources import tables, vectors
from triptych.staging import new_path

# White space as the library sees it, for regular expressions of the other engine.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)


@query("scan_items", "SELECT doc_id, lang, source, n_chars, text FROM documents")
def scan_items(spark, folder):
    path = new_path(spark, "items-csv")
    tables.export_csv(table(spark, folder, "documents"), path)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return tables.load_table(spark, path, schema, format="csv")


@query(
    "scan_pruned",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 'Ñandú ' || c_name || ' é' AS c_name FROM customer",
)
def scan_pruned(spark, folder):
    path = new_path(spark, "latin-csv")
    named = table(spark, folder, "customer").withColumn("c_name", F.concat(F.lit("Ñandú "), "c_name", F.lit(" é")))
    tables.export_csv(named, path, encoding="ISO-8859-1")
    return tables.read_csv(spark, path, ["c_custkey", "c_name"], encoding="ISO-8859-1", multiline=False)


@query(
    "scan_embeddings",
    """SELECT vec_id AS item_id, CAST(len(embedding) AS BIGINT) AS width,
              unnest(range(0, len(embedding))) AS pos, round(CAST(unnest(embedding) AS DOUBLE), 6) AS x
       FROM embeddings""",
)
def scan_embeddings(spark, folder):
    path = new_path(spark, "vectors")
    vectors.save_vectors(table(spark, folder, "embeddings").withColumnRenamed("vec_id", "item_id"), path)
    loaded = vectors.load_vectors(spark, [path + "-preferred", path])
    return loaded.select("item_id", F.size("embedding").alias("width"), F.posexplode("embedding").alias("pos", "x")).withColumn(
        "x", F.round(F.col("x").cast("double"), 6)
    )


@query(
    "index_stale_keys",
    """SELECT vec_id AS item_id, 'new' AS reason FROM embeddings WHERE vec_id % 10 = 0
       UNION ALL SELECT vec_id, 'changed' FROM embeddings WHERE vec_id % 10 = 1
       UNION ALL SELECT vec_id + 1000000, 'gone' FROM embeddings WHERE vec_id % 10 = 2""",
)
def index_stale_keys(spark, folder):
    """The saved table lacks some vectors, holds old versions of others, and some that are gone."""
    now = table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    k = F.col("item_id")
    negated = F.transform("embedding", lambda x: -x)
    then = now.where(k % 10 != 0).withColumn("embedding", F.when(k % 10 == 1, negated).otherwise(F.col("embedding")))
    gone = now.where(k % 10 == 2).withColumn("item_id", k + 1000000)
    path = new_path(spark, "search")
    vectors.save_search_table(then.unionByName(gone), path)
    saved = spark.read.schema("item_id bigint, embedding array<double>, source_hash bigint").parquet(path)
    return vectors.stale_keys(now, saved)


@query(
    "coerce_numeric",
    """SELECT o_orderkey, round(CASE o_orderkey % 9
           WHEN 0 THEN o_totalprice WHEN 5 THEN o_totalprice * 10 WHEN 6 THEN -o_totalprice
           WHEN 7 THEN o_totalprice WHEN 8 THEN 0.5 END, 4) AS price
       FROM orders""",
)
def coerce_numeric(spark, folder):
    k = F.col("o_orderkey")
    text = F.col("o_totalprice").cast("string")
    written = (
        F.when(k % 9 == 0, F.concat(F.lit("\t "), text, F.lit(" ")))
        .when(k % 9 == 1, "abc")
        .when(k % 9 == 2, "1,000")
        .when(k % 9 == 3, "12d")
        .when(k % 9 == 4, "NaN")
        .when(k % 9 == 5, F.concat(text, F.lit("e1")))
        .when(k % 9 == 6, F.concat(F.lit("-"), text))
        .when(k % 9 == 7, text)
        .otherwise(".5")
    )
    raw = table(spark, folder, "orders").select("o_orderkey", written.alias("price"))
    return tables.coerce_numeric(raw, ["price", "absent"]).withColumn("price", F.round("price", 4))


@query(
    "fill_nulls",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Unknown' ELSE c_mktsegment END AS authors,
              CASE WHEN c_custkey % 7 = 0 THEN 0.0 ELSE c_acctbal END AS popularity, c_name AS original_title
       FROM customer""",
)
def fill_nulls(spark, folder):
    k = F.col("c_custkey")
    holes = table(spark, folder, "customer").select(
        k,
        F.when(k % 5 != 0, F.col("c_mktsegment")).alias("authors"),
        F.when(k % 7 != 0, F.col("c_acctbal")).alias("popularity"),
        F.when(k % 2 != 0, F.col("c_name")).alias("original_title"),
        F.col("c_name").alias("title"),
    )
    filled = tables.fill_missing(holes, {"authors": "Unknown", "popularity": 0.0}, {"original_title": "title"})
    return filled.drop("title")


@query(
    "normalise_names",
    """SELECT c_custkey, 'saint-' || lower(c_mktsegment) || ' o''brien ' || c_custkey AS city,
              'NATION ' || c_nationkey AS country,
              'Saint-' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))
                || ' O''Brien ' || c_custkey AS name
       FROM customer""",
)
def normalise_names(spark, folder):
    raw = table(spark, folder, "customer").select(
        "c_custkey",
        F.concat(F.lit("\t saint-"), F.lower("c_mktsegment"), F.lit(" o'brien "), F.col("c_custkey").cast("string"), F.lit("  \n")).alias("raw"),
        F.concat(F.lit(" nation "), F.col("c_nationkey").cast("string")).alias("code"),
    )
    city = cleaning.strip(F.col("raw"))
    return raw.select(
        "c_custkey",
        city.alias("city"),
        F.upper(cleaning.strip(F.col("code"))).alias("country"),
        cleaning.title_case(city).alias("name"),
    )


@query(
    "filter_items",
    f"""WITH {bind.ITEMS}
       SELECT item_id, title, votes, round(rating, 6) AS rating FROM items
       WHERE length(title) > 8 AND votes BETWEEN 20 AND 40 AND rating >= 24 AND category <> 'ECONOMY'""",
)
def filter_items(spark, folder):
    kept = bind.items(spark, folder).where(
        (F.length("title") > 8)
        & F.col("votes").between(20, 40)
        & (F.col("rating") >= 24)
        & (F.col("category") != "ECONOMY")
    )
    return kept.select("item_id", "title", "votes", F.round("rating", 6).alias("rating"))


@query(
    "parse_bool",
    """SELECT o_orderkey, o_orderkey % 8 IN (0, 1, 2, 3, 4) AS explicit, o_orderkey % 8 NOT IN (0, 1, 2, 3, 4) AS clean
       FROM orders""",
)
def parse_bool(spark, folder):
    k = F.col("o_orderkey") % 8
    words = ("TRUE", "true", "1", "T", "yes", "no", "False")
    text = F.coalesce(*[F.when(k == i, F.lit(w)) for i, w in enumerate(words)])
    flagged = table(spark, folder, "orders").select("o_orderkey", cleaning.is_true_text(text).alias("explicit"))
    return flagged.withColumn("clean", ~F.col("explicit"))


@query(
    "word_count_filter",
    f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '{NOT_SPACE}+')) AS BIGINT) AS words
       FROM documents WHERE len(regexp_extract_all(text, '{NOT_SPACE}+')) >= 40""",
)
def word_count_filter(spark, folder):
    counted = table(spark, folder, "documents").select("doc_id", cleaning.word_count(F.col("text")).alias("words"))
    return counted.where(F.col("words") >= 40)


@query(
    "display_name",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN c_name
           ELSE upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || '-Town' END AS name
       FROM customer""",
)
def display_name(spark, folder):
    k = F.col("c_custkey")
    display = F.when(k % 3 == 0, "").when(k % 3 == 2, F.col("c_name"))
    city = F.concat(F.lower("c_mktsegment"), F.lit("-town"))
    return table(spark, folder, "customer").select(k, cleaning.first_filled(display, cleaning.title_case(city)).alias("name"))


TIER = """CASE WHEN population > 1000000 THEN 'major metropolitan area' WHEN population > 500000 THEN 'large city'
  WHEN population > 100000 THEN 'medium-sized city' ELSE 'charming town' END"""
BADGE = """CASE WHEN population IS NULL OR population <= 0 THEN ''
  WHEN population >= 1000000 THEN '🏙️ Major city (' || printf('%.1f', population / 1000000) || 'M people)'
  WHEN population >= 500000 THEN '🌆 Large city (' || format('{:,}', population) || ' people)'
  WHEN population >= 100000 THEN '🏘️ Medium city (' || format('{:,}', population) || ' people)'
  ELSE '🏡 Small town (' || format('{:,}', population) || ' people)' END"""


@query("population_tier", f"WITH {bind.PLACES} SELECT place_id, {TIER} AS tier, {BADGE} AS badge FROM places")
def population_tier(spark, folder):
    population = F.col("population")
    return bind.places(spark, folder).select(
        "place_id",
        describing.place_tier(population).alias("tier"),
        describing.population_badge(population).alias("badge"),
    )


FEATURES = """
features AS (
  SELECT p_partkey AS track_id, CASE WHEN p_partkey % 19 <> 0 THEN p_name END AS track_name, p_brand AS artists,
         CASE WHEN p_partkey % 23 <> 0 THEN p_type END AS track_genre,
         CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey % 11) / 10 END AS energy,
         (p_partkey % 7) / 6 AS valence, (p_partkey % 13) / 12 AS danceability
  FROM part)"""
AUDIO = """concat_ws('. ', track_name, 'by ' || artists, track_genre || ' genre',
  CASE WHEN energy > 0.7 THEN 'high energy' WHEN energy < 0.3 THEN 'calm low energy' END,
  CASE WHEN valence > 0.7 THEN 'joyful upbeat' WHEN valence < 0.3 THEN 'melancholic sad' END,
  CASE WHEN danceability > 0.7 THEN 'danceable' END)"""


def features(spark, folder):
    k = F.col("p_partkey")
    return table(spark, folder, "part").select(
        k.alias("track_id"),
        F.when(k % 19 != 0, F.col("p_name")).alias("track_name"),
        F.col("p_brand").alias("artists"),
        F.when(k % 23 != 0, F.col("p_type")).alias("track_genre"),
        F.when(k % 17 != 0, (k % 11) / 10).alias("energy"),
        ((k % 7) / 6).alias("valence"),
        ((k % 13) / 12).alias("danceability"),
    )


@query("describe_features", f"WITH {FEATURES} SELECT track_id, {AUDIO} AS audio_description FROM features")
def describe_features(spark, folder):
    names = ("track_name", "artists", "track_genre", "energy", "valence", "danceability")
    described = describing.describe_audio(*[F.col(c) for c in names])
    return features(spark, folder).select("track_id", described.alias("audio_description"))


PLACE_TEXT = f"""concat_ws('. ', name || ' is a city in ' || country, {TIER},
  CASE WHEN population > 0 THEN 'population ' || format('{{:,}}', population) END,
  CASE WHEN length(trim(region)) > 0 THEN 'in ' || region || ' region' END) || '.'"""


@query("describe_place", f"WITH {bind.PLACES} SELECT place_id, {PLACE_TEXT} AS description FROM places")
def describe_place(spark, folder):
    columns = [F.col(c) for c in ("name", "country", "population", "region")]
    return bind.places(spark, folder).select("place_id", describing.describe_place(*columns).alias("description"))


PLACE_SENTENCES = """concat_ws(' ', name || ' is a city in ' || country || '.',
  CASE WHEN population > 0 THEN 'It has an estimated population of about ' || format('{:,}', population) || ' people.' END,
  CASE WHEN length(trim(region)) > 0 THEN 'It is located in region ' || region || '.' END,
  CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 'The city lies in the '
    || CASE WHEN latitude >= 0 THEN 'northern' ELSE 'southern' END || ' and '
    || CASE WHEN longitude >= 0 THEN 'eastern' ELSE 'western' END || ' hemispheres.' END)"""


@query("describe_place_hemi", f"WITH {bind.PLACES} SELECT place_id, {PLACE_SENTENCES} AS description FROM places")
def describe_place_hemi(spark, folder):
    columns = [F.col(c) for c in ("name", "country", "population", "region", "latitude", "longitude")]
    return bind.places(spark, folder).select(
        "place_id", describing.describe_place_sentences(*columns).alias("description")
    )


@query(
    "text_repr",
    """SELECT doc_id, concat_ws('. ', 'Title ' || doc_id, CASE WHEN doc_id % 5 > 1 THEN text END,
              CASE WHEN doc_id % 3 <> 0 THEN lang END) AS text_representation
       FROM documents""",
)
def text_repr(spark, folder):
    k = F.col("doc_id")
    return table(spark, folder, "documents").select(
        k,
        describing.text_representation(
            F.concat(F.lit("Title "), k.cast("string")),
            F.when(k % 5 == 0, "").when(k % 5 > 1, F.col("text")),
            F.when(k % 3 != 0, F.col("lang")),
        ).alias("text_representation"),
    )


@query(
    "text_repr_books",
    """SELECT p_partkey, concat_ws('. ', p_name, p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_type END) AS text_representation
       FROM part""",
)
def text_repr_books(spark, folder):
    tags = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("")
    return table(spark, folder, "part").select(
        "p_partkey",
        describing.text_representation(F.col("p_name"), F.col("p_brand"), tags).alias("text_representation"),
    )


@query(
    "embedding_text",
    "SELECT p_partkey, concat_ws(' ', p_name, p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_size END) AS embedding_text FROM part",
)
def embedding_text(spark, folder):
    size = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size"))
    return table(spark, folder, "part").select(
        "p_partkey", describing.embedding_text(F.col("p_name"), F.col("p_brand"), size).alias("embedding_text")
    )


COLLAPSED = f"regexp_replace(regexp_replace(text, '{SPACE}+', ' ', 'g'), '^ | $', '', 'g')"


@query(
    "collapse_ws",
    f"SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '' ELSE {COLLAPSED} END AS text FROM documents",
)
def collapse_ws(spark, folder):
    text = F.when(F.col("doc_id") % 50 != 0, F.col("text"))
    return table(spark, folder, "documents").select("doc_id", cleaning.collapse_spaces(text).alias("text"))


@query(
    "excerpt",
    """SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 297) || '...'
                           WHEN length(text) > 50 THEN text END AS excerpt
       FROM documents
       UNION ALL
       SELECT -1 - item_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 297) || '...'
                                 WHEN length(text) > 50 THEN text END
       FROM benchmark""",
)
def excerpt(spark, folder):
    short = table(spark, folder, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), "text")
    texts = table(spark, folder, "documents").select("doc_id", "text").unionByName(short)
    return texts.select("doc_id", describing.excerpt(F.col("text")).alias("excerpt"))


@query(
    "codepoint_bucket",
    """SELECT doc_id, CAST(list_sum(list_transform(string_split(text, ''), lambda ch: ord(ch))) % 1000 AS BIGINT) AS bucket
       FROM documents""",
)
def codepoint_bucket(spark, folder):
    return table(spark, folder, "documents").select("doc_id", describing.code_point_bucket(F.col("text")).alias("bucket"))


WIKI = "'https://en.wikipedia.org/wiki/' || replace({name}, ' ', '_')"
MAPS = "'https://www.google.com/maps/search/' || replace(url_encode({name}), '%2F', '/') || '+' || {country}"


@query(
    "build_links",
    f"""WITH named AS (SELECT s_suppkey, 'São ' || s_name || ' a*b~c/d&e+' || s_nationkey AS name, n_name AS country
          FROM supplier JOIN nation ON s_nationkey = n_nationkey)
       SELECT s_suppkey, {WIKI.format(name='name')} AS wiki_link, {MAPS.format(name='name', country='country')} AS maps_link
       FROM named""",
)
def build_links(spark, folder):
    nation = table(spark, folder, "nation")
    name = F.concat(F.lit("São "), "s_name", F.lit(" a*b~c/d&e+"), F.col("s_nationkey").cast("string"))
    named = table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select(
        "s_suppkey",
        describing.wiki_link(name).alias("wiki_link"),
        describing.maps_link(name, F.col("n_name")).alias("maps_link"),
    )
