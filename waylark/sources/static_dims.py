"""Fixed dimension rows of the 2026 tournament and their idempotent load."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waylark.functions.scalars import local_ts
from waylark.operators.enrich import resolve_fk
from waylark.operators.upsert import upsert
from waylark.sources import schemas

# Team | code | flag
TEAMS = [
    ("Afrique du Sud", "RSA", "🇿🇦"),
    ("Algérie", "ALG", "🇩🇿"),
    ("Allemagne", "GER", "🇩🇪"),
    ("Angleterre", "ENG", "🏴󠁧󠁢󠁥󠁮󠁧󠁿"),
    ("Arabie Saoudite", "KSA", "🇸🇦"),
    ("Argentine", "ARG", "🇦🇷"),
    ("Australie", "AUS", "🇦🇺"),
    ("Autriche", "AUT", "🇦🇹"),
    ("Belgique", "BEL", "🇧🇪"),
    ("Bosnie-Herzégovine", "BIH", "🇧🇦"),
    ("Brésil", "BRA", "🇧🇷"),
    ("Canada", "CAN", "🇨🇦"),
    ("Cap-Vert", "CPV", "🇨🇻"),
    ("Colombie", "COL", "🇨🇴"),
    ("Côte d'Ivoire", "CIV", "🇨🇮"),
    ("Croatie", "CRO", "🇭🇷"),
    ("Curaçao", "CUW", "🇨🇼"),
    ("Ecosse", "SCO", "🏴󠁧󠁢󠁳󠁣󠁴󠁿"),
    ("Égypte", "EGY", "🇪🇬"),
    ("Équateur", "ECU", "🇪🇨"),
    ("Espagne", "ESP", "🇪🇸"),
    ("États-Unis", "USA", "🇺🇸"),
    ("France", "FRA", "🇫🇷"),
    ("Ghana", "GHA", "🇬🇭"),
    ("Haïti", "HAI", "🇭🇹"),
    ("Irak", "IRQ", "🇮🇶"),
    ("Iran", "IRN", "🇮🇷"),
    ("Japon", "JPN", "🇯🇵"),
    ("Jordanie", "JOR", "🇯🇴"),
    ("Maroc", "MAR", "🇲🇦"),
    ("Mexique", "MEX", "🇲🇽"),
    ("Norvège", "NOR", "🇳🇴"),
    ("Nouvelle-Zélande", "NZL", "🇳🇿"),
    ("Ouzbékistan", "UZB", "🇺🇿"),
    ("Panama", "PAN", "🇵🇦"),
    ("Paraguay", "PAR", "🇵🇾"),
    ("Pays-Bas", "NED", "🇳🇱"),
    ("Portugal", "POR", "🇵🇹"),
    ("Qatar", "QAT", "🇶🇦"),
    ("RD Congo", "COD", "🇨🇩"),
    ("République de Corée", "KOR", "🇰🇷"),
    ("Sénégal", "SEN", "🇸🇳"),
    ("Suède", "SWE", "🇸🇪"),
    ("Suisse", "SUI", "🇨🇭"),
    ("Tchéquie", "CZE", "🇨🇿"),
    ("Tunisie", "TUN", "🇹🇳"),
    ("Turquie", "TUR", "🇹🇷"),
    ("Uruguay", "URU", "🇺🇾"),
]

# Host city | country | flag
CITIES = [
    ("New York", "US", "🇺🇸"),
    ("Los Angeles", "US", "🇺🇸"),
    ("San Francisco", "US", "🇺🇸"),
    ("Dallas", "US", "🇺🇸"),
    ("Miami", "US", "🇺🇸"),
    ("Houston", "US", "🇺🇸"),
    ("Atlanta", "US", "🇺🇸"),
    ("Seattle", "US", "🇺🇸"),
    ("Boston", "US", "🇺🇸"),
    ("Philadelphie", "US", "🇺🇸"),
    ("Kansas City", "US", "🇺🇸"),
    ("Toronto", "CA", "🇨🇦"),
    ("Vancouver", "CA", "🇨🇦"),
    ("Mexico City", "MX", "🇲🇽"),
    ("Monterrey", "MX", "🇲🇽"),
    ("Guadalajara", "MX", "🇲🇽"),
]

# Host city | airport code | name | latitude | longitude
AIRPORTS = [
    ("New York", "EWR", "Newark Liberty Intl", "40.6895", "-74.1745"),
    ("New York", "JFK", "John F. Kennedy Intl", "40.6413", "-73.7781"),
    ("New York", "LGA", "LaGuardia Airport", "40.7769", "-73.8740"),
    ("Los Angeles", "LAX", "Los Angeles Intl", "33.9425", "-118.4081"),
    ("Los Angeles", "BUR", "Hollywood Burbank", "34.2007", "-118.3585"),
    ("Los Angeles", "SNA", "John Wayne Airport", "33.6757", "-117.8682"),
    ("Los Angeles", "LGB", "Long Beach Airport", "33.8177", "-118.1516"),
    ("San Francisco", "SFO", "San Francisco Intl", "37.6213", "-122.3790"),
    ("San Francisco", "SJC", "San Jose Mineta Intl", "37.3626", "-121.9290"),
    ("San Francisco", "OAK", "Oakland Intl", "37.7213", "-122.2208"),
    ("Dallas", "DFW", "Dallas/Fort Worth Intl", "32.8998", "-97.0403"),
    ("Dallas", "DAL", "Dallas Love Field", "32.8481", "-96.8512"),
    ("Miami", "MIA", "Miami Intl", "25.7959", "-80.2870"),
    ("Miami", "FLL", "Fort Lauderdale-Hollywood", "26.0726", "-80.1527"),
    ("Houston", "IAH", "George Bush Intercontinental", "29.9902", "-95.3368"),
    ("Houston", "HOU", "William P. Hobby Airport", "29.6454", "-95.2789"),
    ("Atlanta", "ATL", "Hartsfield-Jackson Atlanta", "33.6407", "-84.4277"),
    ("Seattle", "SEA", "Seattle-Tacoma Intl", "47.4502", "-122.3088"),
    ("Seattle", "BFI", "Boeing Field", "47.5300", "-122.3019"),
    ("Boston", "BOS", "Boston Logan Intl", "42.3656", "-71.0096"),
    ("Philadelphie", "PHL", "Philadelphia Intl", "39.8744", "-75.2424"),
    ("Kansas City", "MCI", "Kansas City Intl", "39.2976", "-94.7139"),
    ("Toronto", "YYZ", "Toronto Pearson Intl", "43.6777", "-79.6248"),
    ("Toronto", "YTZ", "Billy Bishop Toronto City", "43.6275", "-79.3962"),
    ("Vancouver", "YVR", "Vancouver Intl", "49.1967", "-123.1815"),
    ("Mexico City", "MEX", "Benito Juárez Intl", "19.4363", "-99.0721"),
    ("Mexico City", "NLU", "Felipe Ángeles Intl", "19.7460", "-99.0151"),
    ("Monterrey", "MTY", "Monterrey Intl", "25.7785", "-100.1067"),
    ("Guadalajara", "GDL", "Miguel Hidalgo y Costilla Intl", "20.5218", "-103.3110"),
]

# Host city | kick-off | team a | team b
MATCHES = [
    ("New York", "2026-09-13 18:00:00", "Brésil", "Maroc"),
    ("New York", "2026-09-16 15:00:00", "France", "Sénégal"),
    ("New York", "2026-09-22 20:00:00", "Norvège", "Sénégal"),
    ("New York", "2026-09-25 16:00:00", "Équateur", "Allemagne"),
    ("New York", "2026-09-27 17:00:00", "Panama", "Angleterre"),
    ("Los Angeles", "2026-09-12 21:00:00", "États-Unis", "Paraguay"),
    ("Los Angeles", "2026-09-15 21:00:00", "Iran", "Nouvelle-Zélande"),
    ("Los Angeles", "2026-09-18 15:00:00", "Suisse", "Bosnie-Herzégovine"),
    ("Los Angeles", "2026-09-21 15:00:00", "Belgique", "Iran"),
    ("Los Angeles", "2026-09-25 22:00:00", "Turquie", "États-Unis"),
    ("San Francisco", "2026-09-13 15:00:00", "Qatar", "Suisse"),
    ("San Francisco", "2026-09-16 00:00:00", "Autriche", "Jordanie"),
    ("San Francisco", "2026-09-19 23:00:00", "Turquie", "Paraguay"),
    ("San Francisco", "2026-09-22 23:00:00", "Jordanie", "Algérie"),
    ("San Francisco", "2026-09-25 22:00:00", "Paraguay", "Australie"),
    ("Dallas", "2026-09-14 16:00:00", "Pays-Bas", "Japon"),
    ("Dallas", "2026-09-17 16:00:00", "Angleterre", "Croatie"),
    ("Dallas", "2026-09-22 13:00:00", "Argentine", "Autriche"),
    ("Dallas", "2026-09-25 19:00:00", "Japon", "Suède"),
    ("Dallas", "2026-09-27 22:00:00", "Jordanie", "Argentine"),
    ("Miami", "2026-09-15 18:00:00", "Arabie Saoudite", "Uruguay"),
    ("Miami", "2026-09-21 18:00:00", "Uruguay", "Cap-Vert"),
    ("Miami", "2026-09-24 18:00:00", "Ecosse", "Brésil"),
    ("Miami", "2026-09-27 19:30:00", "Colombie", "Portugal"),
    ("Houston", "2026-09-14 13:00:00", "Allemagne", "Curaçao"),
    ("Houston", "2026-09-17 13:00:00", "Portugal", "RD Congo"),
    ("Houston", "2026-09-20 13:00:00", "Pays-Bas", "Suède"),
    ("Houston", "2026-09-23 13:00:00", "Portugal", "Ouzbékistan"),
    ("Houston", "2026-09-26 20:00:00", "Cap-Vert", "Arabie Saoudite"),
    ("Atlanta", "2026-09-15 12:00:00", "Espagne", "Cap-Vert"),
    ("Atlanta", "2026-09-18 12:00:00", "Tchéquie", "Afrique du Sud"),
    ("Atlanta", "2026-09-21 12:00:00", "Espagne", "Arabie Saoudite"),
    ("Atlanta", "2026-09-24 18:00:00", "Maroc", "Haïti"),
    ("Atlanta", "2026-09-27 19:30:00", "RD Congo", "Ouzbékistan"),
    ("Seattle", "2026-09-15 15:00:00", "Belgique", "Égypte"),
    ("Seattle", "2026-09-19 15:00:00", "États-Unis", "Australie"),
    ("Seattle", "2026-09-24 15:00:00", "Bosnie-Herzégovine", "Qatar"),
    ("Seattle", "2026-09-26 23:00:00", "Égypte", "Iran"),
    ("Boston", "2026-09-13 21:00:00", "Haïti", "Ecosse"),
    ("Boston", "2026-09-16 18:00:00", "Irak", "Norvège"),
    ("Boston", "2026-09-19 18:00:00", "Ecosse", "Maroc"),
    ("Boston", "2026-09-23 16:00:00", "Angleterre", "Ghana"),
    ("Boston", "2026-09-26 15:00:00", "Norvège", "France"),
    ("Philadelphie", "2026-09-14 19:00:00", "Côte d'Ivoire", "Équateur"),
    ("Philadelphie", "2026-09-19 20:30:00", "Brésil", "Haïti"),
    ("Philadelphie", "2026-09-22 17:00:00", "France", "Irak"),
    ("Philadelphie", "2026-09-25 16:00:00", "Curaçao", "Côte d'Ivoire"),
    ("Philadelphie", "2026-09-27 17:00:00", "Croatie", "Ghana"),
    ("Kansas City", "2026-09-16 21:00:00", "Argentine", "Algérie"),
    ("Kansas City", "2026-09-20 20:00:00", "Équateur", "Curaçao"),
    ("Kansas City", "2026-09-25 19:00:00", "Tunisie", "Pays-Bas"),
    ("Kansas City", "2026-09-27 22:00:00", "Algérie", "Autriche"),
    ("Toronto", "2026-09-12 15:00:00", "Canada", "Bosnie-Herzégovine"),
    ("Toronto", "2026-09-17 19:00:00", "Ghana", "Panama"),
    ("Toronto", "2026-09-20 16:00:00", "Allemagne", "Côte d'Ivoire"),
    ("Toronto", "2026-09-23 19:00:00", "Panama", "Croatie"),
    ("Toronto", "2026-09-26 15:00:00", "Sénégal", "Irak"),
    ("Vancouver", "2026-09-13 00:00:00", "Australie", "Turquie"),
    ("Vancouver", "2026-09-18 18:00:00", "Canada", "Qatar"),
    ("Vancouver", "2026-09-21 21:00:00", "Nouvelle-Zélande", "Égypte"),
    ("Vancouver", "2026-09-24 15:00:00", "Suisse", "Canada"),
    ("Vancouver", "2026-09-26 23:00:00", "Nouvelle-Zélande", "Belgique"),
    ("Mexico City", "2026-09-11 15:00:00", "Mexique", "Afrique du Sud"),
    ("Mexico City", "2026-09-17 22:00:00", "Ouzbékistan", "Colombie"),
    ("Mexico City", "2026-09-24 21:00:00", "Tchéquie", "Mexique"),
    ("Monterrey", "2026-09-14 22:00:00", "Suède", "Tunisie"),
    ("Monterrey", "2026-09-20 00:00:00", "Tunisie", "Japon"),
    ("Monterrey", "2026-09-24 21:00:00", "Afrique du Sud", "République de Corée"),
    ("Guadalajara", "2026-09-11 22:00:00", "République de Corée", "Tchéquie"),
    ("Guadalajara", "2026-09-18 21:00:00", "Mexique", "République de Corée"),
    ("Guadalajara", "2026-09-23 22:00:00", "Colombie", "RD Congo"),
    ("Guadalajara", "2026-09-26 20:00:00", "Uruguay", "Espagne"),
]

STAGE = "Group Stage"


def _next_ids(fresh: DataFrame, stored: DataFrame, id_col: str, order: str) -> DataFrame:
    """Number new rows after the highest stored id. Dimension rows only."""
    start = stored.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("m")).first()["m"]
    number = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(order)) + F.lit(start)
    return fresh.withColumn(id_col, number.cast("int"))


def _filled(stored: DataFrame, id_col: str, fresh: DataFrame) -> list:
    """Stored columns in order, null where the source has none."""
    known = {*fresh.columns, id_col}
    return [
        F.col(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name)
        for f in stored.schema.fields
    ]


def _add_new(stored: DataFrame, source: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    fresh = source.join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(_next_ids(fresh, stored, id_col, "_n").select(*_filled(stored, id_col, fresh)))


def load_dims(spark: SparkSession, stored: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Teams, cities, airports and matches merged into what is stored.

    Loading twice changes nothing. Known teams and airports stay as they are,
    known cities get flag and host mark, known matches (by date and city) get teams
    and stage.
    """
    kept = stored or {}
    have = lambda name, schema: kept.get(name, spark.createDataFrame([], schema))
    now = local_ts("2026-01-01 00:00:00")

    team_src = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(TEAMS)], "_n int, team_name string, team_code string, flag string")
    team = _add_new(have("team", schemas.TEAM), team_src, ["team_name"], "id_team")

    city_src = spark.createDataFrame(
        [(i, *r, True) for i, r in enumerate(CITIES)],
        "_n int, city string, country string, flag string, is_host_city boolean")
    city = _add_new(have("city", schemas.CITY), city_src, ["city"], "id_city")
    city = upsert(city, city_src.drop("_n"), ["city"], ["flag", "is_host_city"], now, None, None)

    airport_src = spark.createDataFrame(
        [(i, c, code, name, Decimal(lat), Decimal(lon)) for i, (c, code, name, lat, lon) in enumerate(AIRPORTS)],
        "_n int, city string, iata_code string, name string, latitude decimal(9,6), longitude decimal(9,6)")
    airport_src = resolve_fk(airport_src, city, ("city", "city"), "id_city", "id_city")
    airport = _add_new(have("airport", schemas.AIRPORT), airport_src, ["iata_code"], "id_airport")

    match_src = spark.createDataFrame(
        [(i, *r, STAGE) for i, r in enumerate(MATCHES)],
        "_n int, city string, kick_off string, a string, b string, stage string")
    match_src = match_src.withColumn("match_date", F.col("kick_off").cast("timestamp_ntz"))
    for natural, name, dim, key, out in (
        ("city", "city", city, "id_city", "id_city"),
        ("a", "team_name", team, "id_team", "id_team_a"),
        ("b", "team_name", team, "id_team", "id_team_b"),
    ):
        match_src = resolve_fk(match_src, dim, (natural, name), key, out)
    keys = ["match_date", "id_city"]
    match = _add_new(have("match", schemas.MATCH), match_src, keys, "match_id")
    match = upsert(match, match_src.select(*keys, "id_team_a", "id_team_b", "stage"), keys,
                   ["id_team_a", "id_team_b", "stage"], now, None, None)
    return {"team": team, "city": city, "airport": airport, "match": match}
