"""Fixed values of Uzbek script, word forms and word lists."""

from __future__ import annotations

# Cyrillic letters and their Latin spellings, in alphabet order.
LETTERS: dict[str, str] = {
    "А": "A", "Б": "B", "В": "V", "Г": "G", "Д": "D", "Е": "E", "Ё": "Yo", "Ж": "J", "З": "Z", "И": "I", "Й": "Y",
    "К": "K", "Л": "L", "М": "M", "Н": "N", "О": "O", "П": "P", "Р": "R", "С": "S", "Т": "T", "У": "U", "Ф": "F",
    "Х": "X", "Ц": "Ts", "Ч": "Ch", "Ш": "Sh", "Щ": "Sh", "Ъ": "'", "Ы": "I", "Ь": "", "Э": "E", "Ю": "Yu", "Я": "Ya",
    "Ҳ": "H", "Қ": "Q", "Ғ": "Gʻ", "Ў": "Oʻ",
}
CYRILLIC_TO_LATIN: dict[str, str] = LETTERS | {k.lower(): v.lower() for k, v in LETTERS.items()}

# What Latin spellings turn back into, digraphs in the order in which they are replaced.
DIGRAPHS_BACK: list[tuple[str, str]] = [
    ("Yo", "Ё"), ("yo", "ё"), ("Ts", "Ц"), ("ts", "ц"), ("Ch", "Ч"), ("ch", "ч"), ("Sh", "Щ"), ("sh", "щ"), ("Yu", "Ю"), ("yu", "ю"),
    ("Ya", "Я"), ("ya", "я"), ("Gʻ", "Ғ"), ("gʻ", "ғ"), ("Oʻ", "Ў"), ("oʻ", "ў"), ("Ng", "Нг"), ("ng", "нг"),
]
#: Of letters with one Latin spelling the later in the alphabet wins (e is Э, i is Ы, ' is the lower-case hard sign).
SINGLES_BACK: dict[str, str] = {v: k for k, v in CYRILLIC_TO_LATIN.items() if len(v) == 1}

# Apostrophes, letters that writers confuse, costs in tenths.
APOSTROPHES = "'ʻʼ"
CONFUSED = ("xh", "iy", "uo", "bp", "dt")
PARTNER: dict[str, str] = {a: b for pair in CONFUSED for a, b in (pair, pair[::-1])}
FULL_COST, CONFUSED_COST, APOSTROPHE_COST = 10, 5, 3

# Thresholds of the checker.
MIN_STEM, MIN_DIRECT_FREQ, MIN_STEM_FREQ, MAX_DISTANCE, AUTONOMOUS_FREQ = 3, 5, 100, 2, 1000
#: A bare -i is not taken off a stem that ends in one of these.
VOWELS = "aeiouʻ"


# The 66 suffixes, longest first, equal lengths by alphabet.
SUFFIXES: list[str] = [
    "laringizning",
    "larimizning", "laringizdan",
    "larimizdan", "laringizda", "laringizga", "laringizni", "laringning",
    "ingizning", "larimizda", "larimizga", "larimizni", "larimning", "laringdan",
    "imizning", "ingizdan", "laridagi", "larimdan", "laringda", "laringga", "laringiz", "laringni",
    "imizdan", "ingizda", "ingizga", "ingizni", "ingning", "lardagi", "laridan", "larimda", "larimga", "larimiz", "larimni",
    "imizda", "imizga", "imizni", "imning", "ingdan", "lardan", "lariga", "laring", "larini",
    "imdan", "ingda", "ingga", "ingiz", "ingni", "larda", "larga", "larim", "larni",
    "dagi", "idan", "imda", "imga", "imiz", "imni", "ning",
    "dan", "ing", "lar",
    "da", "ga", "im", "ni",
    "i",
]
LONGEST_SUFFIX = len(SUFFIXES[0])

# Word lists of the corpus jobs.
SHORT_WORDS = "va bu u o' ha yo ey oh ga da ni to bo go ko".split()
ENGLISH_NOISE = (
    "the and for are was you that this with from have will not but all one into more also been its can said about than had they their who would "
    "there when what which were each she him his her our out use how man new way may day get has did come made part over such then only just know "
    "like time very after through back little good well even much before most other some these while where being"
).split()
BLOCKED_WEB = "the of and in to is was for on are with at by an as or be from this that thumb left right center frame alt ref cite".split()
BLOCKED_NEWS = "the and for are was you that this with from have has will not but all www com http https html css jpg png kun news read more share like view".split()
BLOCKED_LAW = "the and for are was from that this with have will not all www com http lex doc pdf html jpg ref".split()
FUNCTION_WORDS = (
    "va bu bir biz siz ular men sen bor ham lekin ammo uchun bilan keyin oldin emas chunki hali endi nima kim qanday qachon shunday bunday agar faqat "
    "hech juda eng edi dedi qildi keldi bordi hamma har yana garchi shuning boshladi"
).split()
TELLING_SUFFIXES = "lardan larga larida larning larini larni ishdi ardi imiz ingiz".split()
ENGLISH_STOP = (
    "the is are was were have has had this that with from they their them would could should about which where there these those what when been being "
    "will your than some into each also very most not but for you all can her his how its may our own say she too use way"
).split()
MENU_WORDS = "File Edit View Insert Format Tools Extensions Help Accessibility".split()
INTERFACE_WORDS = (
    "file edit view insert format tools extensions help undo redo print share new open save cut copy paste zoom find replace menu toolbar accessibility "
    "normal text heading font bold italic underline align left right center table image link comment numbered bulleted list paragraph spacing columns "
    "page break margins headers footers"
).split()
