"""Script profiles: what the text functions need to know about a script, so that no rule names a language itself."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import cache


@dataclass(frozen=True)
class ScriptProfile:
    """Character classes are bodies of bracket expressions that Java's and RE2's regular expressions share."""

    name: str
    block: str
    stopwords: tuple[str, ...]
    units: tuple[tuple[str, int], ...]
    unit_synonyms: tuple[tuple[str, str], ...] = ()
    media_tags: tuple[str, ...] = ()
    endings: tuple[str, ...] = (".", "!", "?")
    forced_phrases: tuple[str, ...] = ()
    meta_patterns: tuple[str, ...] = ()
    repetition_ignored: tuple[str, ...] = ()
    #: Phrases that a first or a last sentence is cut off for.
    opening_markers: tuple[str, ...] = ()
    closing_markers: tuple[str, ...] = ()
    #: Name, strong words and weak words, in the order of their precedence.
    categories: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = field(default=())
    #: Pairs of a pattern of a word torn apart and the word.
    repairs: tuple[tuple[str, str], ...] = ()
    #: Characters that may end the first part of a torn cluster, the sign that joins, and signs that must not follow it.
    cluster_ends: str = ""
    joining_sign: str = ""
    dependent_signs: str = ""


# Word lists and labels of the Latin profile, for the languages of the test tables.
LATIN = ScriptProfile(
    name="latin",
    block=r"A-Za-zÀ-ÖØ-öø-ÿ",
    stopwords=(
        "the", "of", "and", "to", "in", "a", "is", "it", "that", "for", "on", "with", "as", "was", "by", "this", "be", "are", "or", "at", "from",
        "de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "qui", "dans", "pour", "par", "sur", "au", "est", "pas", "avec",
        "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als",
        "el", "los", "las", "y", "del", "se", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como",
    ),
    units=(("thousand", 1_000), ("lakh", 100_000), ("million", 1_000_000), ("crore", 10_000_000), ("billion", 1_000_000_000)),
    unit_synonyms=(("ten lakh", "million"),),
    media_tags=("photos", "photo", "video", "videos", "gallery", "update"),
    forced_phrases=("in conclusion", "it is important to note", "as an ai"),
    meta_patterns=("here is the rewritten", "rewritten article"),
    repetition_ignored=("that", "this", "with", "from"),
    opening_markers=("Did you know", "did you know"),
    closing_markers=("time to discuss",),
    categories=(
        ("Sports", ("cricket", "match", "wicket", "tournament", "team", "league"), ("victory", "defeat", "win")),
        ("International", ("united states", "russia", "china", "india", "japan", "foreign"), ()),
        ("Politics", ("election", "minister", "parliament", "party", "president"), ("decision", "statement", "protest")),
    ),
)

# Word lists and labels of the Sinhala profile. Stop words of two words are left out, since no token can equal one.
SINHALA = ScriptProfile(
    name="sinhala",
    block="඀-෿",
    stopwords=(
        "සහ", "වන", "ලැබේ", "ඇත", "විසින්", "බව", "සඳහා", "මෙම", "අතර", "ගැන", "ගැනීම", "වූ", "සිට", "ද", "හා", "වෙත", "කර", "කරන", "ලෙස", "එම",
        "මගින්", "පිළිබඳ", "ගැනීමට", "ඉතිරි", "ලබා", "නොමැත", "නොවේ", "ඇති", "නැත", "සිදු", "වී", "වීම", "පමණක්", "කිරීමට", "කිරීම", "වූහ", "වෙති",
        "නැවත", "අනුව", "වෙනුවෙන්", "ඔහු", "ඇය", "ඔවුන්", "එය", "මෙසේ", "අද", "ඊයේ", "හෙට",
    ),
    units=(("ලක්ෂ", 100_000), ("මිලියන", 1_000_000), ("කෝටි", 10_000_000), ("බිලියන", 1_000_000_000)),
    unit_synonyms=(("දශ ලක්ෂ", "මිලියන"),),
    endings=(".", "!", "?", "।", "යි", "වේ", "බව", "තිබේ", "කරයි", "විය", "ඇත", "තිබුණි", "තිබුණා", "කළේය"),
    meta_patterns=("මෙන්න", "නැවත ලියූ ලිපිය", "rewritten article", "here is the rewritten"),
    repetition_ignored=("සඳහන්", "විසින්", "සඳහා", "ලෙස", "අතර", "පිළිබඳ", "කිරීම", "තිබේ"),
    media_tags=("වීඩියෝ", "ඡායාරූප", "VIDEO", "PHOTOS?", "PICTURES?", "Interview", "GALLERY"),
    opening_markers=("විශ්ලේෂණය කරන විට", "දන්නවද?", "ඇහුවද?", "මේක අහන්න!"),
    closing_markers=("ඉදිරි ක්‍රියාමාර්ග පිළිබඳව සාකච්ඡා කළ යුතු කාලය එළඹ ඇත", "අනිවාර්යයෙන්ම දැනගන්න", "අනාගත පරම්පරාවට ද ආදර්ශයක් වනු ඇත"),
    categories=(
        (
            "Sports",
            (
                "ක්‍රිකට්", "T20", "ODI", "ටෙස්ට්", "කඩුලු", "කඩුල්ල", "පන්දු", "ශතකය", "අර්ධ ශතකය", "ඩබල් ශතකය", "ඉනිම", "විකට්", "ලකුණු",
                "කුසලානය", "ලෝක කුසලානය", "එක්දින", "ක්‍රීඩක", "ක්‍රීඩිකාවන්", "ක්‍රීඩා", "ක්‍රීඩාව", "තරග", "තරගාවලිය", "කණ්ඩායම", "ජාතික කණ්ඩායම",
                "ලීග්", "තරගාවලිය", "නෙට්බෝල්", "පාපන්දු", "රග්බි", "වොලිබෝල්", "බැඩ්මින්ටන්", "ටෙනිස්", "හොකී", "ඇතිලට්", "මැරතන්",
            ),
            (
                "තරගය", "තරග", "තරගාවලිය", "ජය", "ජයක්", "පරාජය", "ජයග්‍රහණය",
            ),
        ),
        (
            "International",
            (
                "අමෙරිකා", "අමෙරිකාවේ", "අමෙරිකාව", "අමෙරිකානු", "බ්‍රිතාන්‍ය", "බ්‍රිතාන්‍යයේ", "බ්‍රිතාන්‍යය", "රුසියා", "රුසියාවේ", "රුසියානු",
                "චීනය", "චීනයේ", "චීන", "ඉන්දියාව", "ඉන්දියාවේ", "ඉන්දීය", "ජපානය", "ජපානයේ", "ජපන්", "කැනඩාව", "කැනඩාවේ", "කැනේඩියානු",
                "ඕස්ට්‍රේලියාව", "ඕස්ට්‍රේලියාවේ", "ඕස්ට්‍රේලියානු", "ජර්මනිය", "ජර්මනියේ", "ජර්මානු", "ප්‍රංශය", "ප්‍රංශයේ", "ප්‍රංශ", "ඉතාලිය",
                "ඉතාලියේ", "ඉතාලි", "ස්පාඤ්ඤය", "ස්පාඤ්ඤයේ", "නෙදර්ලන්තය", "නෙදර්ලන්තයේ", "ස්විට්සර්ලන්තය", "ස්විට්සර්ලන්තයේ", "නෝර්වේ", "නෝර්වේයේ",
                "ස්වීඩනය", "ස්වීඩනයේ", "ඩෙන්මාර්කය", "ඩෙන්මාර්කයේ", "ෆින්ලන්තය", "ෆින්ලන්තයේ", "තුර්කිය", "තුර්කියේ", "තුර්කි", "ඉරානය", "ඉරානයේ",
                "ඉරාන", "ඉරාකය", "ඉරාකයේ", "සෞදි", "සෞදි අරාබිය", "සෞදි අරාබියේ", "ඊශ්‍රායලය", "ඊශ්‍රායලයේ", "පලස්තීනය", "පලස්තීනයේ", "ඇෆ්ගනිස්ථානය",
                "ඇෆ්ගනිස්ථානයේ", "ඇෆ්ගන්", "පාකිස්ථානය", "පාකිස්ථානයේ", "පාකිස්ථාන", "බංග්ලාදේශය", "බංග්ලාදේශයේ", "නේපාලය", "නේපාලයේ", "භූතානය",
                "භූතානයේ", "මියන්මාරය", "මියන්මාරයේ", "තායිලන්තය", "තායිලන්තයේ", "වියට්නාමය", "වියට්නාමයේ", "දකුණු කොරියාව", "දකුණු කොරියාවේ",
                "උතුරු කොරියාව", "උතුරු කොරියාවේ", "සිංගප්පූරුව", "සිංගප්පූරුවේ", "මැලේසියාව", "මැලේසියාවේ", "ඉන්දුනීසියාව", "ඉන්දුනීසියාවේ",
                "පිලිපීනය", "පිලිපීනයේ", "මෙක්සිකෝව", "මෙක්සිකෝවේ", "බ්‍රසීලය", "බ්‍රසීලයේ", "ආර්ජෙන්ටිනාව", "ආර්ජෙන්ටිනාවේ", "චිලී", "චිලියේ",
                "දකුණු අප්‍රිකාව", "දකුණු අප්‍රිකාවේ", "නයිජීරියාව", "නයිජීරියාවේ", "ඊජිප්තුව", "ඊජිප්තුවේ", "ලිබියාව", "ලිබියාවේ", "යුක්රේනය",
                "යුක්රේනයේ", "පෝලන්තය", "පෝලන්තයේ", "හංගේරියාව", "හංගේරියාවේ", "චෙක්", "චෙක් ජනරජය", "චෙක් ජනරජයේ",
            ),
            (),
        ),
        (
            "Politics",
            (
                "අමාත්‍ය", "අමාත්‍යවරයා", "අමාත්‍යංශ", "ජනාධිපති", "අගමැති", "පාර්ලිමේන්තුව", "මන්ත්‍රී", "මන්ත්‍රීවරයා", "රජය", "ආණ්ඩුව",
                "විරෝධී පක්ෂය", "පක්ෂය", "ජනපති", "පාලනය", "රජයේ", "මැතිවරණය", "ඡන්දය", "පාර්ලිමේන්තු", "ආණ්ඩුක්‍රම ව්‍යවස්ථාව", "රනිල්",
                "ප්‍රා‍දේශීය සභා", "පක්ෂයේ", "මහලේකම්", "දේශපාලනය", "දේශපාලනයට", "මැතිවරණ", "ආණ්ඩු", "මහින්ද රාජපක්ෂ", "ජනාධිපති",
            ),
            (
                "තීරණය", "ප්‍රකාශ", "චෝදනා", "නියෝග", "සම්මත", "රැස්වීම", "පත්", "පාලන", "විරෝධතා",
            ),
        ),
    ),
    repairs=(
        ("ප්‍ර +දේශ", "ප්‍රදේශ"),
        ("පා +රිභෝගික", "පාරිභෝගික"),
        ("වී +යාජ", "ව්‍යාජ"),
        ("මහේස්ත්‍ +රාත්", "මහේස්ත්‍රාත්"),
        ("අත් +අඩංගුවට", "අත්අඩංගුවට"),
    ),
    cluster_ends="ර්‍",
    joining_sign="්",
    dependent_signs="ාැෑිීුූෘෙේෛොෝෞෟ",
)


@cache
def combining_class() -> str:
    """The body of a bracket expression with all code points of a canonical combining class other than 0, from Python's Unicode data."""
    marks = [c for c in range(0x110000) if unicodedata.combining(chr(c))]
    runs, start = [], marks[0]
    for before, now in zip(marks, [*marks[1:], -2], strict=True):
        if now != before + 1:
            runs.append(f"\\x{{{start:x}}}" if start == before else f"\\x{{{start:x}}}-\\x{{{before:x}}}")
            start = now
    return "".join(runs)
