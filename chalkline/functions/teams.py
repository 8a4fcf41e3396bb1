"""Team codes: one lookup from every spelling a feed uses to the three-letter code of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.functions.values import as_col

# Fixed values: (full name, short abbreviation used by feeds, code of the data model).
TEAMS = [
    ("Arizona Cardinals", "ARI", "ari"), ("Atlanta Falcons", "ATL", "atl"),
    ("Baltimore Ravens", "BAL", "bal"), ("Buffalo Bills", "BUF", "buf"),
    ("Carolina Panthers", "CAR", "car"), ("Chicago Bears", "CHI", "chi"),
    ("Cincinnati Bengals", "CIN", "cin"), ("Cleveland Browns", "CLE", "cle"),
    ("Dallas Cowboys", "DAL", "dal"), ("Denver Broncos", "DEN", "den"),
    ("Detroit Lions", "DET", "det"), ("Green Bay Packers", "GB", "gnb"),
    ("Houston Texans", "HOU", "hou"), ("Indianapolis Colts", "IND", "ind"),
    ("Jacksonville Jaguars", "JAX", "jax"), ("Kansas City Chiefs", "KC", "kan"),
    ("Las Vegas Raiders", "LV", "lvr"), ("Los Angeles Chargers", "LAC", "lac"),
    ("Los Angeles Rams", "LAR", "lar"), ("Miami Dolphins", "MIA", "mia"),
    ("Minnesota Vikings", "MIN", "min"), ("New England Patriots", "NE", "nwe"),
    ("New Orleans Saints", "NO", "nor"), ("New York Giants", "NYG", "nyg"),
    ("New York Jets", "NYJ", "nyj"), ("Philadelphia Eagles", "PHI", "phi"),
    ("Pittsburgh Steelers", "PIT", "pit"), ("San Francisco 49ers", "SF", "sfo"),
    ("Seattle Seahawks", "SEA", "sea"), ("Tampa Bay Buccaneers", "TB", "tam"),
    ("Tennessee Titans", "TEN", "ten"), ("Washington Commanders", "WSH", "was"),
]
# Renamed and relocated franchises, and spellings single feeds use.
ALIASES = {
    "jac": "jax", "washington": "was", "washington redskins": "was", "washington football team": "was",
    "oakland raiders": "lvr", "san diego chargers": "lac", "st. louis rams": "lar", "st louis rams": "lar",
    "arz": "ari", "ram": "lar", "la": "lar", "oak": "lvr", "sdg": "lac", "stl": "lar",
}
# Codes of relocated teams still found in older seasons.
LEGACY_CODES = {"oak": "lvr", "sdg": "lac", "stl": "lar"}
# Teams that play under a roof at home (all others are outdoor).
DOME_TEAMS = ["ari", "atl", "dal", "det", "hou", "ind", "lac", "lar", "lvr", "min", "nor"]


def spellings() -> dict[str, str]:
    """Every accepted lower-case spelling -> team code."""
    table: dict[str, str] = {}
    for full, short, code in TEAMS:
        for key in (short, code, full, full.split()[-1]):
            table[key.lower()] = code
    return {**table, **ALIASES}


def map_literal(pairs: dict) -> Column:
    """A constant map as one parsed expression (keys are text, values text or numbers)."""
    text = lambda x: "'" + x.replace("'", "\\'") + "'" if isinstance(x, str) else f"{float(x)!r}D"
    return F.expr("map(" + ", ".join(f"{text(k)}, {text(v)}" for k, v in pairs.items()) + ")")


def normalize_team(raw: Column | str) -> Column:
    """Trim, drop a trailing D/ST, look up the text, then its last word; '' when unknown, NULL for NULL."""
    lookup = map_literal(spellings())
    text = F.lower(F.trim(F.regexp_replace(F.trim(as_col(raw)), r"(?i)\s*D/?ST\s*$", "")))
    last = F.element_at(F.split(text, r"\s+"), -1)
    return F.when(as_col(raw).isNotNull(), F.coalesce(lookup[text], lookup[last], F.lit("")))


def rewrite_legacy(code: Column | str) -> Column:
    c = as_col(code)
    return F.coalesce(map_literal(LEGACY_CODES)[c], c)


def roof_type(home_team: Column | str) -> Column:
    """'dome'/'outdoor' for a known team code, NULL otherwise."""
    c = as_col(home_team)
    codes = [code for _, _, code in TEAMS]
    return F.when(c.isin(DOME_TEAMS), F.lit("dome")).when(c.isin(codes), F.lit("outdoor"))
