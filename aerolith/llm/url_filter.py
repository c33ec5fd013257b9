"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a host with a path prefix (``net/es/``) or a pattern over the whole URL, in which ``*`` stands
for anything, ``^`` for a separator or the end and ``||`` for the beginning of a host or one of its
labels. A pattern ``|-word-|`` fits a host that has the word as a label or as a part of one between
hyphens. Patterns do not tell A-Z from a-z. Each rule becomes one regular expression and a set of literal tokens that every URL it fits must
contain. It is filed under the one of them that is rarest in the URLs at hand. The tokens of a URL fetch
the rules filed under them, and only those are run.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALLOW, BLOCK = "allow", "block"
#: Rules are broadcast to all tasks, so their number is bounded.
MOST_RULES = 200_000

_TOKEN = re.compile(r"[a-z0-9]+")
_SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|$)"
#: What is around a host's label or a part of it between hyphens. A user name is no part of the host, nor is the port.
_PART_BEGINS = r"^[^:/?#]+://(?:[^/?#]*@)?(?:[^/?#@:]*[.-])?"
_PART_ENDS = r"(?:[.-][^/?#@:]*)?(?::[0-9]*)?(?:[/?#\n]|$)"


def _either_case(c: str) -> str:
    return f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c)


@dataclass(frozen=True)
class Rule:
    """``site``: host and path prefix. Otherwise ``text`` is a pattern. Longer site rules win over all else."""

    text: str
    action: str
    site: bool = False

    def regex(self) -> str:
        """For a site: over host + path, as ``parts_of`` gives them. For a pattern: over the URL."""
        if self.site:
            return r"^(?:[^/]*\.)?" + re.escape(self.text)
        body = self.text
        head = tail = ""
        if body.startswith("|-") and body.endswith("-|"):
            head, body, tail = _PART_BEGINS, body[2:-2], _PART_ENDS
        elif body.startswith("||"):
            head, body = r"^[^:/?#]+://(?:[^/?#]*\.)?", body[2:]
        parts = {"*": ".*", "^": _SEPARATOR}
        return head + "".join(parts.get(c) or _either_case(c) for c in body) + tail

    def tokens(self) -> set[str]:
        """Tokens that are whole in every URL the rule fits: a literal run with a non-token sign at both its ends."""
        text = self.text.lower()
        found = set()
        for m in _TOKEN.finditer(text):
            a, b = m.span()
            opens = a == 0 and self.site or a > 0 and text[a - 1] != "*"
            closes = b < len(text) and text[b] != "*"
            if opens and closes:
                found.add(m.group())
        return found


#: Words that tell a host's kind as a label or as a part of one between hyphens.
HOST_WORDS = {
    "adult": """adult adults brazzers camgirl camgirls camsex chaturbate erotic erotica escort escorts fetish fuck hentai hookup
        hookups livejasmin milf milfs naked nsfw nude nudes nudity onlyfans porn porno pornhub pornos redtube sexcam sexcams sexshop
        sexy striptease swinger swingers threesome webcamsex xhamster xnxx xvideos xxx youporn""",
    "spam": """bet bets betting bingo blackjack bookmaker bookmakers casino casinos cialis clickbait counterfeit cracked gamble
        gambling getrich jackpot jackpots keygen keygens levitra linkfarm loan loans lotto lottery payday pill pills poker
        replica replicas roulette scam scams slots spam spammer spammers sportsbet sportsbook steroids sweepstakes torrent
        torrents viagra warez xanax""",
    "advertising": """adclick adclicks adform adnetwork adnxs ads adsense adserv adserver adservers adservice adsrv adsystem
        adtech advert adverts advertise advertisement advertisements advertiser advertising adwords clickbank clickserve criteo
        doubleclick googleadservices googlesyndication outbrain popads popunder popunders popup popups pubmatic rubiconproject
        taboola zedo""",
    "tracking": """adtrack adtracker clicktrack clicktracker googletagmanager hotjar mixpanel scorecardresearch telemetry tracker
        trackers tracking webbug""",
}
#: Words that do so only as a whole label with others after it: they are parts of many good names.
LABELS = ["ad", "adv", "affiliate", "affiliates", "analytics", "banner", "banners", "beacon", "click", "clicks", "counter", "metrics", "pixel", "promo", "sex", "sponsor", "stats", "track"]


def pattern_rules() -> list[Rule]:
    """General rules for pages that are not worth reading: adult pages, spam shops, advertising and tracking."""
    spam = ["casino", "bets", "pills", "poker", "viagra", "porn", "loans", "escort"]
    paths = ["/ads/", "/adserver/", "/banner/", "/doubleclick/", "/tracking/", "/login^", "/cart^", "/wp-admin/"]
    hosts = [p for w in spam for p in (f"://{w}^", f"://{w}.", f".{w}.", f"-{w}.", f".{w}-", f"-{w}-", f"://{w}-")]
    parts = [f"|-{w}-|" for words in HOST_WORDS.values() for w in words.split()]
    return [Rule(p, BLOCK) for p in hosts + paths + parts + [f"||{w}." for w in LABELS]]


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts_of(url: str | Column = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    c = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(c, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(c, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(_ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def url_tokens(url: str | Column = "url") -> Column:
    c = F.col(url) if isinstance(url, str) else url
    return F.array_distinct(F.regexp_extract_all(_ascii_lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def token_frequencies(urls: DataFrame, rules: Sequence[Rule], url: str = "url") -> dict[str, int]:
    """In how many URLs the rules' tokens occur. Only the rules' own tokens reach the driver."""
    wanted = sorted(set().union(*[r.tokens() for r in rules])) if rules else []
    if not wanted:
        return {}
    names = urls.sparkSession.createDataFrame([(w,) for w in wanted], "token string")
    seen = urls.select(F.explode(url_tokens(url)).alias("token")).join(F.broadcast(names), "token", "left_semi")
    return {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def index_rules(rules: Sequence[Rule], frequencies: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Token -> places of the rules filed under it (their rarest), and the rules without a token."""
    filed, loose = defaultdict(list), []
    for i, rule in enumerate(rules):
        tokens = rule.tokens()
        if tokens:
            filed[min(tokens, key=lambda t: (frequencies.get(t, 0), -len(t), t))].append(i)
        else:
            loose.append(i)
    return dict(filed), loose


class Matcher:
    """Candidate rules by token, then their regular expressions; compiled once per process."""

    def __init__(self, rules: Sequence[Rule], filed: dict[str, list[int]], loose: list[int]):
        self.rules, self.filed, self.loose = rules, filed, loose
        self.compiled: dict[int, re.Pattern] = {}

    def fits(self, i: int, url: str, place: str) -> bool:
        if i not in self.compiled:
            self.compiled[i] = re.compile(self.rules[i].regex(), re.S)
        return self.compiled[i].search(place if self.rules[i].site else url) is not None

    def judge(self, url: str | None, host: str, path: str) -> tuple[str | None, str | None, str]:
        """Site rule, pattern and verdict. The longest site rule decides; else a blocking pattern unless one allows."""
        if url is None:
            return None, None, ALLOW
        candidates = list(self.loose)
        for token in dict.fromkeys(_TOKEN.findall(_lower(url))):
            candidates += self.filed.get(token, ())
        fitting = [self.rules[i] for i in candidates if self.fits(i, url, host + path)]
        sites = [r for r in fitting if r.site]
        if sites:
            best = max(sites, key=lambda r: (len(r.text), r.text))
            return best.text, None, best.action
        patterns = [r for r in fitting if not r.site]
        if not patterns:
            return None, None, ALLOW
        best = min(patterns, key=lambda r: (r.action != ALLOW, r.text))
        return None, best.text, best.action


def _lower(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def filter_urls(urls: DataFrame, rules: Sequence[Rule], url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep``, host, path, rule (the site rule or null), pattern (the pattern or null) and verdict of each row.

    A URL that nothing fits is allowed. A null URL and one without ``://`` have no host and no path, so no
    site rule fits them; patterns still apply to the latter. Rows are kept one for one, repeated ones too.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are broadcast")
    filed, loose = index_rules(rules, token_frequencies(urls, rules, url))
    shared = urls.sparkSession.sparkContext.broadcast((list(rules), filed, loose))
    host, path = parts_of(url)
    result = T.StructType([T.StructField(n, T.StringType()) for n in ("rule", "pattern", "verdict")])

    @F.pandas_udf(result)
    def judged(parts):
        import pandas as pd

        matcher = Matcher(*shared.value)
        columns = (parts["url"], parts["host"], parts["path"])
        return pd.DataFrame([matcher.judge(u if isinstance(u, str) else None, h, p) for u, h, p in zip(*columns, strict=True)], columns=["rule", "pattern", "verdict"])

    judged.__annotations__ = {}
    parts = urls.select(*keep, F.col(url).alias("_url"), host.alias("host"), path.alias("path"))
    scored = parts.withColumn("_j", judged(F.struct(F.col("_url").alias("url"), "host", "path")))
    return scored.select(*keep, "host", "path", "_j.rule", "_j.pattern", "_j.verdict")
