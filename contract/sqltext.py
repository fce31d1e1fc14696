"""Pieces of checking SQL (DuckDB)."""

from contract.views import AS_OF, EXPERIMENT, RUNS_AS_OF

SPACE_SET = r"\t\n\x0B\f\r\x1c-\x1f\x85\p{Z}"
WORD = r"[\p{L}\p{N}_]"


def rnd(x: str, n: int) -> str:
    """Rounded once, from the shortest text of the number."""
    return f"cast(round(cast(cast(cast({x} AS double) AS varchar) AS decimal(38,18)), {n}) AS double)"


def pct(part: str, whole: str) -> str:
    return rnd(f"cast({part} AS double) * 100 / nullif(cast({whole} AS double), 0)", 2)


def initcap(x: str) -> str:
    return f"concat(upper(left({x}, 1)), lower(substr({x}, 2)))"


def since(days: str, column: str = "predicted_at", as_of: str = AS_OF) -> str:
    return f"{column} >= timestamp '{as_of}' - interval '{days}'"


RUNS_OF = (
    "FROM runs r JOIN experiments e ON r.experiment_id = e.experiment_id "
    "{joins} "
    f"WHERE e.name = '{EXPERIMENT}' AND r.deleted_time IS NULL "
)


def runs_of(joins: str = "", days: str | None = None) -> str:
    text = RUNS_OF.format(joins=joins)
    return text + (f"AND {since(days, 'r.start_time', RUNS_AS_OF)} " if days else "")


def url(x: str) -> str:
    return f"regexp_replace({x}, 'http[^{SPACE_SET}]+|www[^{SPACE_SET}]+', 'HTTPURL', 'g')"


def mention(x: str) -> str:
    return f"regexp_replace({x}, '@{WORD}+', '@USER', 'g')"


def emoji(x: str) -> str:
    for found, name in {
        "😂": "face_with_tears_of_joy",
        "👍🏽": "thumbs_up_medium_skin_tone",
        "❤️": "red_heart",
        "🇮🇩": "Indonesia",
        "🙏": "folded_hands",
        "👨‍👩‍👧": "family_man_woman_girl",
        "👩🏿‍💻": "woman_technologist_dark_skin_tone",
        "2️⃣": "keycap_2",
        "🤷‍♀️": "woman_shrugging",
        "🏳️‍🌈": "rainbow_flag",
        "😡": "enraged_face",
    }.items():
        x = f"replace({x}, '{found}', ':{name}:')"
    return x


def entity(x: str) -> str:
    return f"regexp_replace({x}, '&{WORD}+;', '', 'g')"


def newline(x: str) -> str:
    return rf"regexp_replace({x}, '[\r\n\t]+', ' ', 'g')"


def harvest_space(x: str) -> str:
    """Two or more of JavaScript's white space characters, listed one by one, become a blank."""
    codes = [9, 10, 11, 12, 13, 32, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279]
    listed = "".join(rf"\x{{{code:X}}}" for code in codes)
    return f"regexp_replace({x}, '[{listed}]{{2,}}', ' ', 'g')"


def space(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE_SET}]+', ' ', 'g'))"


def cleaned(x: str) -> str:
    return space(newline(entity(emoji(mention(url(f"lower(coalesce({x}, ''))"))))))
