"""Emoji to ``:name:``.

Names follow the English short names of the Unicode locale data. They are made
from the character names by rule, with a list of exceptions; a caller with the
full table passes it as ``names``. The table of all sequences is built on the
driver and is a constant of the plan, so the texts never leave the JVM.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------

# Code points with the Emoji property above U+007F (Unicode emoji-data).
EMOJI_RANGES = """
A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2
25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A
262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697
2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1
26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721
2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935
2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E
1F191-1F19A 1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397
1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570
1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4
1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2
1F6D5-1F6D7 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A
1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FA88 1FA90-1FABD 1FABF-1FAC5 1FACE-1FADB 1FAE0-1FAE8
1FAF0-1FAF8
"""

# Code points that take a skin tone (property Emoji_Modifier_Base).
TONE_RANGES = """
261D 26F9 270A-270D 1F385 1F3C2-1F3C4 1F3C7 1F3CA-1F3CC 1F442-1F443 1F446-1F450 1F466-1F478 1F47C
1F481-1F483 1F485-1F487 1F48F 1F491 1F4AA 1F574-1F575 1F57A 1F590 1F595-1F596 1F645-1F647
1F64B-1F64F 1F6A3 1F6B4-1F6B6 1F6C0 1F6CC 1F90C 1F90F 1F918-1F91F 1F926 1F930-1F939 1F93C-1F93E
1F977 1F9B5-1F9B6 1F9B8-1F9B9 1F9BB 1F9CD-1F9CF 1F9D1-1F9DD 1FAC3-1FAC5 1FAF0-1FAF8
"""

SKIN_TONES = {
    0x1F3FB: "light_skin_tone",
    0x1F3FC: "medium-light_skin_tone",
    0x1F3FD: "medium_skin_tone",
    0x1F3FE: "medium-dark_skin_tone",
    0x1F3FF: "dark_skin_tone",
}

# Short names that differ from the character name beyond the rules below.
EXCEPTIONS = {
    "❤": "red_heart", "♥": "heart_suit", "♦": "diamond_suit", "♣": "club_suit", "♠": "spade_suit",
    "☺": "smiling_face", "☹": "frowning_face", "☀": "sun", "☎": "telephone", "⚡": "high_voltage",
    "✂": "scissors", "✏": "pencil", "✔": "check_mark", "✖": "multiply", "❗": "red_exclamation_mark",
    "❓": "red_question_mark", "♻": "recycling_symbol", "♾": "infinity", "⭐": "star",
    "✅": "check_mark_button", "❌": "cross_mark", "❎": "cross_mark_button", "➕": "plus",
    "➖": "minus", "➗": "divide", "✌": "victory_hand", "☝": "index_pointing_up",
    "➡": "right_arrow", "⬅": "left_arrow", "⬆": "up_arrow", "⬇": "down_arrow",
    "▶": "play_button", "◀": "reverse_button", "⏩": "fast-forward_button",
    "⏪": "fast_reverse_button", "⚕": "medical_symbol", "™": "trade_mark", "©": "copyright",
    "®": "registered", "😁": "beaming_face_with_smiling_eyes", "😃": "grinning_face_with_big_eyes",
    "😄": "grinning_face_with_smiling_eyes", "😅": "grinning_face_with_sweat",
    "😆": "grinning_squinting_face", "😍": "smiling_face_with_heart-eyes",
    "😘": "face_blowing_a_kiss", "😋": "face_savoring_food", "😛": "face_with_tongue",
    "😜": "winking_face_with_tongue", "😝": "squinting_face_with_tongue", "🤩": "star-struck",
    "🤪": "zany_face", "🥰": "smiling_face_with_hearts", "🥲": "smiling_face_with_tear",
    "🥳": "partying_face", "🥺": "pleading_face", "🥶": "cold_face", "🥵": "hot_face",
    "🥴": "woozy_face", "🤯": "exploding_head", "🤭": "face_with_hand_over_mouth",
    "🤫": "shushing_face", "🤬": "face_with_symbols_on_mouth", "🤮": "face_vomiting",
    "🤨": "face_with_raised_eyebrow", "🤠": "cowboy_hat_face", "😤": "face_with_steam_from_nose",
    "😥": "sad_but_relieved_face", "😰": "anxious_face_with_sweat", "😓": "downcast_face_with_sweat",
    "😺": "grinning_cat", "😸": "grinning_cat_with_smiling_eyes", "😹": "cat_with_tears_of_joy",
    "😻": "smiling_cat_with_heart-eyes", "😼": "cat_with_wry_smile", "😽": "kissing_cat",
    "🙀": "weary_cat", "😿": "crying_cat", "😾": "pouting_cat", "👽": "alien", "💩": "pile_of_poo",
    "💯": "hundred_points", "💥": "collision", "💫": "dizzy", "💦": "sweat_droplets",
    "💨": "dashing_away", "💤": "ZZZ", "👋": "waving_hand", "👌": "OK_hand", "👍": "thumbs_up",
    "👎": "thumbs_down", "👊": "oncoming_fist", "👏": "clapping_hands", "👐": "open_hands",
    "🙌": "raising_hands", "🙏": "folded_hands", "🤞": "crossed_fingers", "🤟": "love-you_gesture",
    "🤝": "handshake", "👇": "backhand_index_pointing_down", "👈": "backhand_index_pointing_left",
    "👉": "backhand_index_pointing_right", "👆": "backhand_index_pointing_up",
    "🖕": "middle_finger", "🙅": "person_gesturing_NO", "🙆": "person_gesturing_OK",
    "🙇": "person_bowing", "🙋": "person_raising_hand", "🤦": "person_facepalming",
    "🤷": "person_shrugging", "🚶": "person_walking", "🏃": "person_running",
    "🎅": "Santa_Claus", "🤶": "Mrs._Claus", "👢": "woman’s_boot", "👡": "woman’s_sandal",
    "🎁": "wrapped_gift", "🏠": "house", "🏀": "basketball", "🎾": "tennis", "🍕": "pizza",
    "🍛": "curry_rice", "🍆": "eggplant", "🌽": "ear_of_corn", "💡": "light_bulb",
    "💻": "laptop", "📢": "loudspeaker", "📣": "megaphone", "🔍": "magnifying_glass_tilted_left",
    "🔎": "magnifying_glass_tilted_right", "🔞": "no_one_under_eighteen", "🔇": "muted_speaker",
    "🔊": "speaker_high_volume", "🚨": "police_car_light", "🛒": "shopping_cart", "🛑": "stop_sign",
    "🌍": "globe_showing_Europe-Africa", "🌎": "globe_showing_Americas",
    "🌏": "globe_showing_Asia-Australia", "🎶": "musical_notes", "🔴": "red_circle",
    "⚪": "white_circle", "⚫": "black_circle", "🔥": "fire", "🆗": "OK_button", "🆘": "SOS_button",
    "🆕": "NEW_button", "🆒": "COOL_button", "🆓": "FREE_button", "🅰": "A_button_(blood_type)",
    "🅱": "B_button_(blood_type)", "🔝": "TOP_arrow", "🔜": "SOON_arrow", "💏": "kiss",
    "🥇": "1st_place_medal", "🥈": "2nd_place_medal", "🥉": "3rd_place_medal",
    "♀": "female_sign", "♂": "male_sign", "☠": "skull_and_crossbones", "⚠": "warning",
    "🆙": "UP!_button", "☑": "check_box_with_check", "✴": "eight-pointed_star", "🔫": "water_pistol",
    "😡": "enraged_face", "🤗": "smiling_face_with_open_hands", "👿": "angry_face_with_horns",
    "🤖": "robot", "👴": "old_man", "👵": "old_woman", "📈": "chart_increasing",
    "📉": "chart_decreasing", "🔒": "locked", "🔓": "unlocked",
}

# Objects that turn a person into a profession when joined to it.
PROFESSIONS = {
    "⚕": "health_worker", "🎓": "student", "🏫": "teacher", "⚖": "judge", "🌾": "farmer",
    "🍳": "cook", "🔧": "mechanic", "🏭": "factory_worker", "💼": "office_worker",
    "🔬": "scientist", "💻": "technologist", "🎤": "singer", "🎨": "artist", "✈": "pilot",
    "🚀": "astronaut", "🚒": "firefighter",
}
HAIR = {"🦰": "red_hair", "🦱": "curly_hair", "🦳": "white_hair", "🦲": "bald"}
JOINED = {
    "❤‍🔥": "heart_on_fire",
    "❤‍🩹": "mending_heart",
    "🏳‍🌈": "rainbow_flag",
    "🏳‍⚧": "transgender_flag",
    "🏴‍☠": "pirate_flag",
    "😶‍🌫": "face_in_clouds",
    "😮‍💨": "face_exhaling",
    "😵‍💫": "face_with_spiral_eyes",
    "👁‍🗨": "eye_in_speech_bubble",
    "🏴\U000E0067\U000E0062\U000E0065\U000E006E\U000E0067\U000E007F": "England",
    "🏴\U000E0067\U000E0062\U000E0073\U000E0063\U000E0074\U000E007F": "Scotland",
    "🏴\U000E0067\U000E0062\U000E0077\U000E006C\U000E0073\U000E007F": "Wales",
}

_FLAG_A = 0x1F1E6
_JOINER = "‍"
_VARIATION = "️"
_KEYCAP = "⃣"

# Where emoji can start: few ranges, so that a text is passed over quickly.
_START = "©®‼-㊙\U0001F000-\U0001FAFF"
CANDIDATE = f"[{_START}\uFE0E\uFE0F{_KEYCAP}]"
# People that have a female and a male form without a skin tone.
_PLAIN_PAIRS = "👯🤼🧞🧟"
_PEOPLE = {"👨": "man", "👩": "woman", "🧑": ""}
_CHILDREN = {"👧": "girl", "👦": "boy"}


def _code_points(ranges: str) -> Iterator[int]:
    for part in ranges.split():
        first, _, last = part.partition("-")
        yield from range(int(first, 16), int(last or first, 16) + 1)


def _by_rule(ch: str) -> str | None:
    name = unicodedata.name(ch, None)
    if name is None:
        return None
    name = name.lower().replace(" ", "_")
    name = re.sub(r"^clock_face_(.*)_oclock$", r"\1_o’clock", name)
    name = re.sub(r"^clock_face_", "", name)
    name = re.sub(r"^(large|medium)_(.*_(?:circle|square))$", r"\2", name)
    name = re.sub(r"^emoji_component_", "", name)
    name = re.sub(r"_(sign|symbol)$", "", name)
    name = re.sub(r"^white_(.*)_ornament$", r"white_\1", name)
    name = re.sub(r"^banknote_with_(.*)$", r"\1_banknote", name)
    return name


@cache
def emoji_table() -> dict[str, str]:
    """Single emoji to short name, made by rule."""
    table = {}
    for code in _code_points(EMOJI_RANGES):
        ch = chr(code)
        name = SKIN_TONES.get(code) or EXCEPTIONS.get(ch) or _by_rule(ch)
        if name:
            table[ch] = name
    table.update(JOINED)
    return table


def country_names(spark) -> dict[str, str]:
    """Flags (pairs of regional indicators) by the JVM's own English country names."""
    locale = spark.sparkContext._jvm.java.util.Locale
    flags = {}
    for code in locale.getISOCountries():
        flag = "".join(chr(_FLAG_A + ord(x) - ord("A")) for x in code)
        flags[flag] = locale("", code).getDisplayCountry(locale.ENGLISH).replace(" ", "_")
    return flags


def _joined(table: dict[str, str]) -> Iterator[tuple[str, str]]:
    """Sequences of several emoji: people with an object, hair or gender, families, couples."""
    shades = {"": "", **{chr(code): f"_{name}" for code, name in SKIN_TONES.items()}}
    for tone, shade in shades.items():
        for person, who in _PEOPLE.items():
            for thing, name in PROFESSIONS.items():
                yield person + tone + _JOINER + thing, "_".join(x for x in (who, name) if x) + shade
            for thing, name in HAIR.items():
                yield person + tone + _JOINER + thing, f"{who or 'person'}{shade}_{name}"
        takes_gender = map(chr, _code_points(TONE_RANGES))
        for base in [*takes_gender, *_PLAIN_PAIRS] if tone == "" else takes_gender:
            for sign, sex in (("♀", "woman"), ("♂", "man")):
                name = table.get(base, "")
                if name:
                    gendered = sex + name[6:] if name.startswith("person_") else f"{sex}_{name}"
                    yield base + tone + _JOINER + sign, gendered + shade
    adults = [("👨",), ("👩",), ("👨", "👨"), ("👨", "👩"), ("👩", "👩")]
    children = [("👦",), ("👧",), ("👧", "👦"), ("👦", "👦"), ("👧", "👧")]
    for parents in adults:
        for kids in children:
            names = [_PEOPLE[x] for x in parents] + [_CHILDREN[x] for x in kids]
            yield _JOINER.join(parents + kids), "_".join(["family", *names])
    two_tones = [(a, b, x + ("" if a == b else y)) for a, x in shades.items() for b, y in shades.items() if bool(a) == bool(b)]
    for a, b, shade in two_tones:
        yield f"🧑{a}{_JOINER}🤝{_JOINER}🧑{b}", "people_holding_hands" + shade
        for one, two in (("👩", "👨"), ("👨", "👨"), ("👩", "👩"), ("🧑", "🧑")):
            names = f"{_PEOPLE[one] or 'person'}_{_PEOPLE[two] or 'person'}{shade}"
            yield f"{one}{a}{_JOINER}❤{_JOINER}{two}{b}", f"couple_with_heart_{names}"
            yield f"{one}{a}{_JOINER}❤{_JOINER}💋{_JOINER}{two}{b}", f"kiss_{names}"


def sequence_table(names: dict[str, str] | None = None) -> dict[str, str]:
    """All known sequences, without variation selectors, to their names; ``names`` come first."""
    single = emoji_table()
    table = {f"{sign}{_KEYCAP}": f"keycap_{sign}" for sign in "0123456789#*"}
    table |= dict(_joined(single))
    for code in _code_points(TONE_RANGES):
        if chr(code) in single:
            table |= {chr(code) + chr(tone): f"{single[chr(code)]}_{name}" for tone, name in SKIN_TONES.items()}
    table |= single
    return {k.replace(_VARIATION, ""): v for k, v in (table | (names or {})).items()}


# The constant is an array of small maps, as a map is searched from its first key.
_SLOTS = 512


def _constant(table: dict[str, str]) -> Column:
    slots: list[dict[str, str]] = [{} for _ in range(_SLOTS)]
    for key, name in table.items():
        slots[ord(key[0]) % _SLOTS][key] = name
    return F.from_json(F.lit(json.dumps(slots)), "array<map<string,string>>")


def demojize(c: Column, names: dict[str, str] | None = None) -> Column:
    """Replace every emoji by ``:name:``; loose variation selectors go.

    ``names`` adds to or replaces entries of :func:`sequence_table`. The longest known
    sequence is named as one; of an unknown one every emoji is named by itself, and a
    skin tone it does not take is named apart. Only texts that hold a candidate are cut
    into emoji and what stands between them.
    """
    table = _constant(sequence_table(names))
    tones = {chr(code): name for code, name in SKIN_TONES.items()}
    after = f"[{_VARIATION}{''.join(tones)}\U000E0020-\U000E007F]*"
    flag = f"[{chr(_FLAG_A)}-{chr(_FLAG_A + 25)}]"
    token = "|".join(
        [
            f"[0-9#*]{_VARIATION}?{_KEYCAP}",
            flag + flag,
            f"[{_START}]{after}(?:{_JOINER}[{_START}]{after})*",
            f"[^{_START}0-9#*]+",
            f"[0-9#*]+(?!{_VARIATION}?{_KEYCAP})",
            "[0-9#*]",
        ]
    )

    def lookup(key: Column) -> Column:
        slot = F.pmod(F.ascii(key), F.lit(_SLOTS))
        return F.try_element_at(F.get(table, slot), key)

    def alone(part: Column) -> Column:
        """One emoji with whatever follows it."""
        rest = F.substring(part, F.lit(2), F.char_length(part))
        for tone, name in tones.items():
            rest = F.replace(rest, F.lit(tone), F.lit(f":{name}:"))
        first = lookup(F.left(part, F.lit(1)))
        return F.coalesce(
            F.concat(F.lit(":"), lookup(part), F.lit(":")),
            F.concat(F.lit(":"), first, F.lit(":"), rest),
            part,
        )

    def named(found: Column) -> Column:
        key = F.replace(found, F.lit(_VARIATION), F.lit(""))
        parts = F.array_join(F.transform(F.split(key, _JOINER), alone), _JOINER)
        known = F.concat(F.lit(":"), lookup(key), F.lit(":"))
        return F.when(found.rlike(f"^(?:[{_START}]|[0-9#*]{_VARIATION}?{_KEYCAP})"), F.coalesce(known, parts)).otherwise(found)

    tokens = F.regexp_extract_all(c, F.lit(token), F.lit(0))
    whole = F.translate(F.array_join(F.transform(tokens, named), ""), _VARIATION + "\uFE0E", "")
    candidate = (F.octet_length(c) != F.char_length(c)) & c.rlike(CANDIDATE)
    return F.when(candidate, whole).otherwise(c)
