from pyspark.sql import functions as F

from murmurate.functions import text as X
from murmurate.functions.emoji import country_names, demojize

CASES = [
    ("Halo @Budi cek https://t.co/AbC &amp; OK", "halo @USER cek HTTPURL ok"),
    ("awwww yes", "aHTTPURL yes"),
    ("mail A.B@Example.com now", "mail a.b@USER.com now"),
    ("  a\xa0\xa0b\n\nc\t d ", "a b c d"),
    ("http", "http"),
    ("www", "www"),
    ("WWW.x.id", "HTTPURL"),
    ("@josé_1 hi", "@USER hi"),
    ("&lt;b&gt; x&y; &", "b x &"),
    ("@@a", "@@USER"),
    ("", ""),
    ("HTTP://A b", "HTTPURL b"),
    ("a&amp;b", "ab"),
    ("\x1ca\x1cb", "a b"),
    (None, ""),
    ("mantap 😂👍🏽", "mantap :face_with_tears_of_joy::thumbs_up_medium_skin_tone:"),
    ("x\r\ny", "x y"),
    ("a b　c", "a b c"),
    ("@ budi &; & amp;", "@ budi &; & amp;"),
    ("no 1️⃣", "no :keycap_1:"),
]


def test_cleaning_cases(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, t string")
    got = [r.c for r in df.select("i", X.clean(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [b for _, b in CASES]


def test_steps_give_the_same(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, full_text string")
    got = [r.clean_text for r in X.with_clean_text(df).orderBy("i").collect()]
    assert got == [b for _, b in CASES]


def test_harvest_keeps_a_single_break(spark):
    df = spark.createDataFrame([("a\nb  c\n\nd",)], "t string")
    assert df.select(X.squeeze_harvested(F.col("t"))).first()[0] == "a\nb c d"


NAMES = [
    ("👩‍💻", ":woman_technologist:"),
    ("👩🏿‍💻", ":woman_technologist_dark_skin_tone:"),
    ("🧑‍🚀", ":astronaut:"),
    ("🤷‍♂️", ":man_shrugging:"),
    ("🤦🏽‍♀️", ":woman_facepalming_medium_skin_tone:"),
    ("1️⃣", ":keycap_1:"),
    ("12⃣#", "1:keycap_2:#"),
    ("❤️‍🔥", ":heart_on_fire:"),
    ("❤", ":red_heart:"),
    ("🔥🏽", ":fire::medium_skin_tone:"),
    ("€5 ← 字", "€5 ← 字"),
    ("🕐", ":one_o’clock:"),
    ("12 # *", "12 # *"),
    ("🏴\U000E0067\U000E0062\U000E0065\U000E006E\U000E0067\U000E007F", ":England:"),
    ("👨‍👩‍👧", ":family_man_woman_girl:"),
    ("👩‍👩‍👧‍👦!", ":family_woman_woman_girl_boy:!"),
    ("👩‍❤️‍👨", ":couple_with_heart_woman_man:"),
    ("👨🏻‍❤️‍💋‍👨🏿", ":kiss_man_man_light_skin_tone_dark_skin_tone:"),
    ("🧑‍🤝‍🧑", ":people_holding_hands:"),
    ("🆙☑️✴️🔫😡🤗", ":UP!_button::check_box_with_check::eight-pointed_star::water_pistol::enraged_face::smiling_face_with_open_hands:"),
    ("🔥‍🔥", ":fire:‍:fire:"),
    ("a 🇮🇩🇸🇬 b", "a :Indonesia::Singapore: b"),
    ("🇮🇮🇩", "🇮🇮🇩"),
    ("© ️x", ":copyright: x"),
    ("\n😂\n", "\n:face_with_tears_of_joy:\n"),
    ("é" * 30000 + "😂" + "7" * 30000, "é" * 30000 + ":face_with_tears_of_joy:" + "7" * 30000),
    (None, None),
    ("", ""),
]


def test_emoji_names(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(NAMES)], "i int, t string")
    named = df.select("i", demojize(F.col("t"), country_names(spark)).alias("n"))
    assert [r.n for r in named.orderBy("i").collect()] == [b for _, b in NAMES]


def test_caller_names_win(spark):
    names = {"🔥": "api", "👨‍👩‍👧": "family"}
    df = spark.createDataFrame([("🔥 👨‍👩‍👧",)], "t string")
    assert df.select(demojize(F.col("t"), names)).first()[0] == ":api: :family:"


def test_texts_stay_in_the_jvm(spark):
    df = X.with_clean_text(spark.createDataFrame([("a 🔥",)], "full_text string"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert df.first().clean_text == "a :fire:"
