import datetime as dt
import unicodedata

from pyspark.sql import functions as F

from stowage.functions import modes, paths, projects, scoring, texts, times


def test_suffix_edges(evaluate):
    names = [".bashrc", "x.tar.gz", "a.", "A.PY", "plain", "..a", "a..b"]
    got = evaluate(names, "v string", lambda F: paths.suffix_of(F.col("v")))
    assert got == [None, ".gz", None, ".py", None, ".a", ".b"]


def test_directory_edges(evaluate):
    given = ["/a.txt", "/a/b.txt", "/a.d/b", "rel/x", "x"]
    got = evaluate(given, "v string", lambda F: paths.directory_of(F.col("v")))
    assert got == ["/", "/a", "/a.d", "rel", ""]


def test_categories(evaluate):
    given = [".mp4", ".JPG", ".pdf", ".zip", ".ts", ".mp3", ".parquet", ".xyz", None, ""]
    got = evaluate(given, "v string", lambda F: paths.category_of("v"))
    assert got == [
        "video", "image", "document", "archive", "code", "audio", "data", "other", "other", "other",
    ]


def test_normal_form(evaluate):
    decomposed = "/caf" + "e\u0301"
    given = [decomposed, "C:\\a\\b", "/plain", None]
    got = evaluate(given, "v string", lambda F: paths.normalize_path(F.col("v")))
    assert got == [unicodedata.normalize("NFC", decomposed), "C:/a/b", "/plain", None]


def test_ancestors_and_depth(evaluate):
    got = evaluate(["/", "/a", "/a/b/c"], "v string", lambda F: paths.ancestors(F.col("v")))
    assert got == [["/"], ["/", "/a"], ["/", "/a", "/a/b", "/a/b/c"]]
    got = evaluate(["/r", "/r/a/b"], "v string", lambda F: paths.depth_below(F.col("v"), "/r"))
    assert got == [0, 2]


def test_mode_and_owner(evaluate):
    got = evaluate([33188, 33261, 16877, 32768], "v int",
                   lambda F: modes.octal_permissions(F.col("v")))
    assert got == ["644", "755", "755", "000"]
    got = evaluate([("ann", 5), (None, 1000)], "o string, u int",
                   lambda F: modes.owner_or_uid(F.col("o"), F.col("u")))
    assert got == ["ann", "1000"]


def test_times(evaluate):
    got = evaluate([0, 86400], "v bigint",
                   lambda F: times.iso_text(times.epoch_to_timestamp(F.col("v"))))
    assert got == [None, "1970-01-02T00:00:00.000000Z"]


def test_age_of_stored_text(evaluate):
    as_of = "2026-01-11 00:00:00"
    given = [
        "2026-01-01T00:00:00.000000Z", "2026-01-10T12:00:00+00:00", None, "", "not-a-date",
        "2026-01-01T00:00:00", "2027-01-01T00:00:00Z",
    ]
    got = evaluate(given, "v string",
                   lambda F: times.days_since(times.parse_iso(F.col("v")), as_of))
    assert got == [10.0, 0.5, 9999.0, 9999.0, 9999.0, 9999.0, 0.0]


def test_stale_score_bands(evaluate):
    ages = [(0.0, 0.0), (30.0, 30.0), (180.0, 180.0), (365.0, 365.0), (10000.0, 10000.0),
            (0.0, 180.0), (180.0, 0.0)]
    got = evaluate(ages, "a double, m double",
                   lambda F: scoring.stale_score(F.col("a"), F.col("m")))
    assert got[0] == 0.0 and got[2] == 0.5 and got[4] == 1.0
    assert 0.05 < got[1] < 0.15 and 0.9 < got[3] < 1.0
    # The time of change weighs more than the time of access.
    assert got[5] > got[6]


def test_tiers(evaluate):
    got = evaluate([None, 0.0999, 0.1, 0.4999, 0.5, 0.8499, 0.85], "v double",
                   lambda F: scoring.tier_by_score(F.col("v")))
    assert got == ["active", "active", "aging", "aging", "stale", "stale", "archive_candidate"]
    got = evaluate([30.0, 30.1, 180.0, 365.0, 365.5], "v double",
                   lambda F: scoring.tier_by_age(F.col("v")))
    assert got == ["active", "aging", "aging", "stale", "archive_candidate"]


def test_artifact_directories(evaluate):
    given = ["/p/node_modules/x", "/p/my_node_modules/x", "/p/build", "/p/src/x"]
    got = evaluate(given, "v string", lambda F: scoring.in_artifact_directory(F.col("v")))
    assert got == [True, False, True, False]


def test_risk(evaluate):
    given = [("code", 0.4, False), ("document", 0.6, False), ("code", 0.8, False),
             ("video", 0.1, False), (None, 0.4, False), (None, 0.6, False), ("code", 0.1, True)]
    got = evaluate(given, "c string, s double, a boolean",
                   lambda F: scoring.risk_level(F.col("c"), F.col("s"), F.col("a")))
    assert got == ["high", "medium", "low", "low", "medium", "low", "low"]


def test_priorities(evaluate):
    gib = 1024**3
    given = [(50 * gib, "low"), (50 * gib, "medium"), (5 * gib, "medium"), (gib, "low"),
             (gib, "medium"), (gib // 2, "medium"), (gib // 2 - 1, "low")]
    got = evaluate(given, "n bigint, r string", lambda F: scoring.priority_of("n", "r"))
    assert got == ["critical", "high", "high", "high", "medium", "medium", "low"]


def test_human_bytes(evaluate):
    given = [0, 1023, 1024, 1536, 1024**2, 1024**3, 5 * 1024**4, 1024 + 256, 1024 + 768,
             2**62 + 2**61]
    got = evaluate(given, "v bigint", lambda F: texts.human_bytes("v"))
    want = []
    for n in given:
        for unit, label in ((1024**3, "GB"), (1024**2, "MB"), (1024, "KB")):
            if n >= unit:
                want.append(f"{n / unit:.1f} {label}")
                break
        else:
            want.append(f"{n} B")
    assert got == want
    assert evaluate([5 * 1024**4], "v bigint", lambda F: texts.human_bytes("v", True)) == ["5.0 TB"]


def test_percent(evaluate):
    got = evaluate([(1, 3), (0, 0), (5, 5)], "p bigint, t bigint",
                   lambda F: texts.percent_text(F.col("p"), F.col("t")))
    assert got == ["33.3%", "0%", "100.0%"]


def test_trend(evaluate):
    given = [(0.0, 100), (1.0, 0), (1.0, 10000), (5.0, 10000), (15.0, 10000), (30.0, 10000),
             (40.0, 10000)]
    got = evaluate(given, "d double, t bigint",
                   lambda F: scoring.trend_of(F.col("d"), F.col("t")))
    assert got == ["stable", "stable", "stable", "slow_growth", "moderate_growth",
                   "rapid_growth", "critical_growth"]


def test_project_names(evaluate):
    given = ["project-copy", "project-final-v2", "app (2)", "x", "Project-2", "my_app_backup",
             "archive", "plain"]
    got = evaluate(given, "v string", lambda F: projects.project_name_key(F.col("v")))
    assert got == ["project", "project-final", "app", "", "project", "my_app", "", "plain"]


def test_inactivity(evaluate):
    got = evaluate([0, 179, 180, 365, 730, 9999], "v int",
                   lambda F: projects.inactivity_bucket(F.col("v")))
    assert got == ["under_6_months", "under_6_months", "6_to_12_months", "1_to_2_years",
                   "over_2_years", "over_2_years"]


def test_whole_days_round_down(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1, 12),)], "v timestamp")
    days = times.whole_days_since(F.col("v"), "2026-01-02 00:00:00")
    later = times.whole_days_since(F.col("v"), "2026-01-01 00:00:00")
    assert df.select(days.alias("a"), later.alias("b")).first() == (0, -1)
