"""Language profiles: the constant tables that every operator takes from one place.

Tables of single letters are pairs of equally long strings, as `translate` takes them.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class LanguageProfile:
    name: str
    alphabet: str
    special: str
    #: regex class of word letters, in the syntax that Java and RE2 share
    letters: str
    #: letter that stands in for a special one -> the special one; one target each
    restore: tuple[str, str]
    digraph: tuple[str, str] | None
    #: special letters -> plain ones, by style
    plain: dict[str, tuple[str, str]]
    #: special letter -> everything that it is written as by mistake
    shadows: dict[str, tuple[str, ...]]
    confusable: tuple[str, str] = ("", "")
    homoglyph: tuple[str, str] = ("", "")
    abbreviations: frozenset[str] = frozenset()
    initials: str = ""
    stop_words: tuple[str, ...] = ()
    short_vowels: str = ""
    diphthongs: tuple[str, ...] = ()
    consonants: str = ""
    loan_letters: str = ""
    no_initial: str = ""
    no_final: str = ""
    final_clusters: tuple[str, ...] = ()
    soft_digraphs: tuple[str, ...] = ()
    #: row of vowel nuclei -> nuclei that may come next
    harmony: tuple[tuple[str, str], ...] = ()
    keyboard: tuple[str, ...] = ()
    #: pairs of letters that cost little to confuse
    cheap: str = ""
    invisible: str = "\u00ad\ufeff\u200b\u200c\u200d\u2060"
    cached: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def long_vowels(self) -> tuple[str, ...]:
        return tuple(v + v for v in self.short_vowels)

    @property
    def nuclei(self) -> str:
        """Regex of a vowel nucleus; two letters come before one."""
        return "|".join([*self.long_vowels, *self.diphthongs, f"[{self.short_vowels}]"])

    @property
    def follows(self) -> tuple[str, ...]:
        """Every allowed pair of adjacent nuclei, as first→second."""
        return tuple(f"{a}→{b}" for first, second in self.harmony for a in first.split() for b in second.split())

    @property
    def word(self) -> str:
        return rf"{self.letters}+(?:[-'’]{self.letters}+)*"

    @property
    def token(self) -> str:
        """Words, Latin words and numbers; a number may carry an affix."""
        latin = "" if self.name == "latin" else r"|[A-Za-z]+(?:[-'’][A-Za-z]+)*"
        return rf"{self.word}{latin}|\p{{Nd}}+(?:[.,:/-]\p{{Nd}}+)*(?:-{self.letters}+)*"


def _cases(a: str, b: str) -> tuple[str, str]:
    return a + a.upper(), b + b.upper()


YAKUT = LanguageProfile(
    name="yakut",
    alphabet="абвгҕдеёжзийклмнҥоөпрсһтуүфхцчшщъыьэюя",
    special="ҕҥөһү",
    letters=r"[\x{0400}-\x{052F}]",
    restore=("гноусhxхьцgny", "ҕҥөүһһһһһҥҕҥү"),
    digraph=("нг", "ҥ"),
    plain={"ru": _cases("ҕҥөүһ", "гноус"), "lat": _cases("ҕҥөүһ", "gnoyh"), "mixed": _cases("ҕҥөүһ", "гноус")},
    shadows={"ҕ": ("г",), "ҥ": ("н", "нг", "ц"), "ө": ("о",), "ү": ("у",), "һ": ("с", "ь", "h")},
    confusable=_cases("ѳӧңӊғұҋ", "ө" + "өҥҥҕүй"),
    homoglyph=("aceopxyABCEHKMOPTXY", "асеорху" + "АВСЕНКМОРТХУ"),
    abbreviations=frozenset("акад б.а в вв г гг доц и.т.б и.т.д им млн млрд о.д.а обл оз проф р руб с стр т тт тыс".split()),
    initials="А-ЯЁӨҮҔҤҺ",
    stop_words=tuple("а бы был была были было быть в вас во вот все всё вы да для до его ее если есть еще же за и из или их к как ко когда кто ли мне мы на не него нет ни но о об он она они от по под при с со так также то только том у уже чем что чтобы эта эти это этого я".split()),
    short_vowels="аыоуэиөү",
    diphthongs=("ыа", "уо", "иэ", "үө"),
    consonants="бвгҕджзйклмнҥпрсһтфхцчшщ",
    loan_letters="вежзфцшщъюяё",
    no_initial="ҕҥй",
    no_final="ҕ",
    final_clusters=("кт", "лт", "мп", "нк", "нт", "рт", "ст"),
    soft_digraphs=("дь", "нь"),
    harmony=(
        ("ы ыы ыа а аа", "ы ыы ыа а аа"),
        ("и ии иэ э ээ", "и ии иэ э ээ"),
        ("оо о", "уу уо у оо о"),
        ("өө ө", "үү үө ү өө ө"),
        ("уу уо у", "аа а уу уо у"),
        ("үү үө ү", "ээ э үү үө ү"),
    ),
    keyboard=("йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю"),
    cheap="ҕг ҥн өо үу һс һь ҥц һх һh ҕg ҥn өo үy өё үю еэ ъь",
)

#: The same operators on Latin texts: diacritics are the special letters.
LATIN = LanguageProfile(
    name="latin",
    alphabet="abcdefghijklmnopqrstuvwxyzäöüßéèêñóíç",
    special="äöüñóéíèêç",
    letters=r"[A-Za-z\x{00C0}-\x{024F}]",
    restore=("aounic", "äöüñíç"),
    digraph=None,
    plain={"ru": _cases("äöüñóéíèêç", "aounoeieec")},
    shadows={"ä": ("a", "ae"), "ö": ("o", "oe"), "ü": ("u", "ue"), "ñ": ("n",), "ó": ("o",), "é": ("e",), "í": ("i",), "è": ("e",), "ê": ("e",), "ç": ("c",)},
    cheap="äa öo üu ñn óo ée íi èe êe çc",
    keyboard=("qwertyuiop", "asdfghjkl", "zxcvbnm"),
)

BOS, EOS = "<s>", "</s>"
#: Costs are hundredths of an edit.
BASE_COST, NEIGHBOUR_COST, CHEAP_COST = 100, 70, 35
MAX_SEARCH_COST, MAX_MINE_COST, CHEAP_ENOUGH = 220, 150, 105
FREQ_WEIGHT, LM_WEIGHT, GRAMMAR_PENALTY = 12, 22, 40
CORROBORATION, MIN_FREQ, MIN_SOURCES, SOLO_FREQ, HELDOUT_EVERY = 3, 3, 2, 20, 200
SHADOW_RATIO, SHADOW_VARIANTS, FREQ_RATIO, MIN_WRONG_FREQ = 8.0, 64, 20, 2
MAX_VARIANTS, BACKOFF = 4096, 0.4
MIN_CHARS, MAX_CHARS, MIN_WORDS = 20, 400, 4
