"""The labelled URL table: (host path, block) of invented sites.

Unwanted sites are named head-tail within one trade, ordinary ones head-tail over all
words; some words ("free", "farm", "track") occur on both sides, so that they decide
nothing alone. Each name comes with several subdomains, endings and paths, the same for
both classes; pages of ordinary sites with an unwanted path are unwanted too."""

from __future__ import annotations

# fixed values: words of unwanted names by trade, (heads, tails)
UNWANTED = {
    "gambling": ("casino bet bets betting poker slots jackpot roulette free lucky", "win casino bets poker bonus jackpot slots online"),
    "drugs": ("cheap discount pharma viagra pills meds", "pills meds tablets pharmacy rx viagra"),
    "adult": ("adult porn xxx nude sex", "x tube cams video live hot"),
    "advertising": ("ads adserver popup banner click", "track tracker pixel network click server"),
    "spam": ("spam seo backlink linkfarm bulkmail junkmail", "farm blast bot mill mailer links"),
}
# fixed values: words of ordinary names
HEADS = "city garden river open green school health travel book music free organic field winter family kitchen science bird north royal".split()
TAILS = "library museum journal notes club guide archive forum news farm track review society market video letter paper reader corner winter history house weekly".split()
SINGLE = ("thornton", "lindenau", "marston", "terrania", "ontheway", "thinking", "rethink", "nathan", "antwerp", "heather", "weather",
          "northern", "therapy", "tension", "motion", "station", "garden", "ingredient", "edition", "anthem")
# fixed values: paths of unwanted pages, whatever the host
PATHS = ("/casino/bonus", "/poker-online/win", "/cheap-pills-online", "/buy-viagra", "/xxx/videos", "/porn-tube/", "/ads/click/track", "/spam/blast.html")
SUBDOMAINS = ("", "www.", "m.", "blog.", "de.", "")
ENDINGS = ("example.com", "example.net", "example.org")
LANGUAGES = ("en", "de", "fr", "es")
FORMS = 6               # rows of each name


def unwanted_names() -> list[str]:
    return [f"{h}-{t}" for heads, tails in UNWANTED.values() for h in heads.split() for t in tails.split() if h != t]


def ordinary_names() -> list[str]:
    return [f"{h}-{t}" for h in HEADS for t in TAILS if h != t] + list(SINGLE)


def forms(name: str, start: int, path: str | None = None) -> list[str]:
    """``FORMS`` sites of a name; which ones follows from its number."""
    out = []
    for k in range(start, start + FORMS):
        plain = f"/{LANGUAGES[k % 4]}/{(k * 7919) % 10000}" + ("", "/", ".html")[k // 3 % 3]
        out.append(f"{SUBDOMAINS[k % 6]}{name}.{ENDINGS[k // 2 % 3]} {path or plain}")
    return out


def table(leave_out: frozenset[str] = frozenset()) -> list[tuple[str, bool]]:
    """(host path, block) of all names but those left out."""
    rows = [(s, True) for k, n in enumerate(unwanted_names()) if n not in leave_out for s in forms(n, k * 5)]
    good = [(k, n) for k, n in enumerate(ordinary_names()) if n not in leave_out]
    rows += [(s, False) for k, n in good for s in forms(n, k * 5)]
    rows += [(s, True) for j, p in enumerate(PATHS) for k, n in good[j::3 * len(PATHS)] for s in forms(n, k * 5, p)]
    return rows
