"""Domain profiles: every constant the analytics and retrieval operators depend on."""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: patterns, word lists and constants that results depend on ----
KEYWORDS = (
    "vero|tulo|ALV|arvonlisä|TVL|AVL|EPL|VML|elinkeinoverolaki|perintö|lahja|kiinteistö|pääoma|ennakon|pidätys|lähdever|yhteisöver|osinko|palkka|"
    "vuokra|myyntivoitto|ulkomainen|rajoitetusti verovelvollinen|key.personnel|avainhenkilö|withholding|eläke|TyEL|MEL|YEL|MYEL|vakuuttamisvelvoll|"
    "työeläke|kansaneläke|sosiaaliturva"
)
BOUNDARIES = (
    r"\n\s*\d+(?:\.\d+){0,3}\s+[A-ZÄÖÅ]",
    r"\n\s*\d+\s*§\s",
    r"\n\s*[A-ZÄÖÅ][A-ZÄÖÅ ]{4,}\n",
)
REFERENCE = r"(\d+[a-zA-Z]?)\s*§|§\s*(\d+[a-zA-Z]?)"
REFERENCE_PAIR = r"(\d+[a-zA-Z]?)\s+ja\s+(\d+[a-zA-Z]?)\s*§"
DATE = r"\b(20\d\d)[.\-/](0?\d|1[0-2])[.\-/](0?\d|[12]\d|3[01])\b"
AMENDMENT = "muuttamisesta"
CITATION = r"§\s*\d+|TVL|AVL|EPL|VML|KHO|KVL|VH-|ohje"
TOKEN = "[a-zäöå0-9§]+"
STATUTES = (
    (r"\bTVL\b", "TVL"),
    (r"\bAVL\b", "AVL"),
    (r"\bEPL\b", "EPL"),
    (r"\bVML\b", "VML"),
    (r"\bTyEL\b", "TyEL"),
    (r"\bMEL\b", "MEL"),
    (r"\bYEL\b", "YEL"),
    (r"\bMYEL\b", "MYEL"),
    ("tuloverola", "TVL"),
    ("arvonlisäverola", "AVL"),
    ("ennakkoperintä", "EPL"),
    ("verotusmenettel", "VML"),
    ("työntekijän eläkelak", "TyEL"),
    ("työntekijäin eläkelak", "TyEL"),
    ("merimieseläkelak", "MEL"),
    ("yrittäjän eläkelak", "YEL"),
    ("maatalousyrittäj.*eläkelak", "MYEL"),
    ("perintö.*lahja", "PerVL"),
    ("kiinteistöver", "KiVL"),
    ("elinkeinoverolak", "EVL"),
    ("lähdeverola", "LähdeVL"),
    ("korkotulojen.*lähdever", "KoroVL"),
    ("varojen siirtymis", "PerVL"),
)
ACRONYMS = (
    ("TyEL", "Työntekijän eläkelaki (TyEL)"),
    ("TVL", "Tuloverolaki (TVL)"),
    ("AVL", "Arvonlisäverolaki (AVL)"),
    ("MEL", "Merimieseläkelaki (MEL)"),
    ("YEL", "Yrittäjän eläkelaki (YEL)"),
    ("MYEL", "Maatalousyrittäjien eläkelaki (MYEL)"),
    ("EPL", "Ennakkoperintälaki (EPL)"),
    ("VML", "Laki verotusmenettelystä (VML)"),
    ("PerVL", "Perintö- ja lahjaverolaki (PerVL)"),
    ("KiVL", "Kiinteistöverolaki (KiVL)"),
    ("EVL", "Elinkeinoverolaki (EVL)"),
)
REFUSALS = (
    "cannot find", "i cannot find", "cannot provide", "cannot answer", "cannot fully answer", "unable to find", "unable to provide",
    "unable to answer", "not enough information", "insufficient information", "do not contain", "do not provide", "no information",
    "en löydä", "valitettavasti, en löydä", "en pysty löytämään", "en löytänyt", "en voi vastata", "ei ole tietoa", "ei sisällä", "en pysty vastaamaan",
)
TIER_BUCKETS = (("basic", ("basic", "difficulty_1", "difficulty_2")), ("medium", ("medium", "difficulty_3")), ("hard", ("hard", "difficulty_4", "difficulty_5")))
TYPE_PRIORITY = (("ARTICLE", 0), ("CLAUSE", 0), ("STATUTE", 0), ("GUIDANCE_S", 1), ("GUIDANCE", 1), ("COURT_CASE", 2))
# ---- end of the fixed values ----


@dataclass(frozen=True)
class Profile:
    """What an operator needs to know about a corpus.  The defaults describe a corpus of tax law."""

    keywords: str = KEYWORDS
    keyword_prefix: int = 2000
    boundaries: tuple[str, ...] = BOUNDARIES
    reference: str = REFERENCE
    reference_pair: str = REFERENCE_PAIR
    date: str = DATE
    amendment: str = AMENDMENT
    citation: str = CITATION
    token: str = TOKEN
    statutes: tuple[tuple[str, str], ...] = STATUTES
    acronyms: tuple[tuple[str, str], ...] = ACRONYMS
    refusals: tuple[str, ...] = REFUSALS
    authority_source: str = "vero"
    statute_source: str = "finlex"
    authority_boost: float = 1.15
    long_marker: str = "Tuloverosopimukset"
    long_boost: float = 1.15
    chunk_chars: int = 800
    chunk_step: int = 650
    chunk_min: int = 120
    section_prefix: int = 1500
    cites_confidence: float = 0.85
    amends_confidence: float = 0.75
    max_targets: int = 3
    ref_decay: float = 0.6
    neighbour_decay: float = 0.75
    refs_per_hit: int = 3
    targets_per_ref: int = 2
    neighbour_span: int = 3
    cap: int = 2
    long_cap: int = 4
    rrf_k: int = 60
    confidence_floor: float = 0.7
    reference_ceiling: float = 0.6
    hop_relations: tuple[str, ...] = ("cites", "amends", "interpreted_by", "overrides")
    frontier_cap: int = 20
    entry_multiple: int = 3
    type_priority: tuple[tuple[str, int], ...] = TYPE_PRIORITY
    tier_buckets: tuple[tuple[str, tuple[str, ...]], ...] = TIER_BUCKETS
    excerpt_chars: int = 2500


DEFAULT = Profile()
