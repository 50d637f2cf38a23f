"""Column functions for user agents, referrers and attribution."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .textkeys import lookup
from .times import col

# Patterns tried in this order; the first match names the value.
BOTS = (
    r"(?i)bot|crawl|spider|slurp|preview|facebookexternalhit|embedly|quora link|whatsapp|telegram|discordbot|headless|"
    r"lighthouse|pingdom|uptime|monitor|curl|wget|python|axios|node-fetch|go-http|java/"
)
DEVICES = [
    (r"(?i)ipad|tablet|kindle|silk|playbook|(android(?!.*mobile))", "tablet"),
    (r"(?i)mobi|iphone|ipod|android|blackberry|opera mini|iemobile", "mobile"),
]
BROWSERS = [
    (r"(?i)edg/", "Edge"),
    (r"(?i)opr/|opera", "Opera"),
    (r"(?i)samsungbrowser", "Samsung Internet"),
    (r"(?i)fbav|fban|instagram", "In-app (Meta)"),
    (r"(?i)firefox|fxios", "Firefox"),
    (r"(?i)chrome|crios", "Chrome"),
    (r"(?i)safari", "Safari"),
]
SYSTEMS = [
    (r"(?i)iphone|ipad|ipod", "iOS"),
    (r"(?i)android", "Android"),
    (r"(?i)windows", "Windows"),
    (r"(?i)mac os x|macintosh", "macOS"),
    (r"(?i)cros", "ChromeOS"),
    (r"(?i)linux", "Linux"),
]
SOURCES = [
    (r"(^|\.)google\.", "Google"),
    (r"(^|\.)bing\.com$", "Bing"),
    (r"duckduckgo\.com$", "DuckDuckGo"),
    (r"(^|\.)yahoo\.", "Yahoo"),
    (r"(^|\.)(chatgpt\.com|openai\.com)$", "ChatGPT"),
    (r"perplexity\.ai$", "Perplexity"),
    (r"claude\.ai$", "Claude"),
    (r"gemini\.google\.com$", "Gemini"),
    (r"copilot\.microsoft\.com$", "Copilot"),
    (r"reddit\.com$|redd\.it$", "Reddit"),
    (r"facebook\.com$|fb\.com$|fb\.me$", "Facebook"),
    (r"instagram\.com$", "Instagram"),
    (r"^t\.co$|(^|\.)(x|twitter)\.com$", "X / Twitter"),
    (r"threads\.net$", "Threads"),
    (r"tiktok\.com$", "TikTok"),
    (r"youtube\.com$|youtu\.be$", "YouTube"),
    (r"linkedin\.com$|lnkd\.in$", "LinkedIn"),
    (r"pinterest\.", "Pinterest"),
    (r"discord\.(com|gg)$", "Discord"),
    (r"bsky\.app$", "Bluesky"),
    (r"mail\.|outlook\.|proton\.me$", "Email"),
]
CHANNELS = {
    "Google": "Search", "Bing": "Search", "DuckDuckGo": "Search", "Yahoo": "Search",
    "ChatGPT": "AI", "Perplexity": "AI", "Claude": "AI", "Gemini": "AI", "Copilot": "AI",
    "Reddit": "Social", "Facebook": "Social", "Instagram": "Social", "X / Twitter": "Social", "Threads": "Social",
    "TikTok": "Social", "YouTube": "Social", "LinkedIn": "Social", "Pinterest": "Social", "Discord": "Social",
    "Bluesky": "Social", "Email": "Email", "Direct": "Direct",
}
ATTRIBUTION = r"^(?:(discover|home):(scarce|back|price)|(taste):(typed|guided|followup)|(search):(exact|rough|browse)|(product):(page))$"


def _first(c: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    out = F.when(c.rlike(rules[0][0]), rules[0][1])
    for pattern, name in rules[1:]:
        out = out.when(c.rlike(pattern), name)
    return out.otherwise(otherwise)


def is_bot(ua: str | Column) -> Column:
    ua = F.coalesce(col(ua), F.lit(""))
    return (ua == "") | ua.rlike(BOTS)


def device(ua: str | Column) -> Column:
    return _first(F.coalesce(col(ua), F.lit("")), DEVICES, F.lit("desktop"))


def browser(ua: str | Column) -> Column:
    return _first(F.coalesce(col(ua), F.lit("")), BROWSERS, F.lit("Other"))


def system(ua: str | Column) -> Column:
    return _first(F.coalesce(col(ua), F.lit("")), SYSTEMS, F.lit("Other"))


def referrer_host(url: str | Column, own: str) -> Column:
    """The cleaned host of a referrer; null for our own site or junk."""
    own = own.removeprefix("www.")
    h = F.lower(F.try_parse_url(col(url), F.lit("HOST")))
    h = F.regexp_replace(h, r"^www\.", "")
    h = F.regexp_replace(h, r"^(m|l|lm)\.", "")
    return F.when((h != "") & (h != own) & ~h.endswith("." + own) & (h != "localhost"), h)


def source(host: str | Column, utm_source: str | Column) -> Column:
    """A friendly source; a campaign's source beats the referrer."""
    host = col(host)
    utm = F.lower(F.coalesce(col(utm_source), F.lit("")))
    capital = F.concat(F.upper(F.substring(utm, 1, 1)), F.substr(utm, F.lit(2)))
    named = F.when(utm.contains("."), F.regexp_replace(utm, r"^www\.", "")).otherwise(capital)
    from_utm = F.when(utm.rlike("e-?mail|newsletter|digest|resend"), "Email").otherwise(_first(utm, SOURCES, named))
    return F.when(utm != "", from_utm).when(host.isNull(), "Direct").otherwise(_first(host, SOURCES, host))


def channel(src: str | Column) -> Column:
    return F.coalesce(lookup(CHANNELS, col(src)), F.lit("Referral"))


def attribution(token: str | Column) -> Column:
    """struct<surface, view> for a known "surface:view" token, else null."""
    token = col(token)
    ok = token.rlike(ATTRIBUTION)
    return F.when(
        ok, F.struct(F.split_part(token, F.lit(":"), F.lit(1)).alias("surface"), F.split_part(token, F.lit(":"), F.lit(2)).alias("view"))
    )


def is_untracked(email: str | Column, admins: list[str] | None = None) -> Column:
    """Administrators and "+test" addresses are left out of analytics."""
    e = F.lower(F.trim(F.coalesce(col(email), F.lit(""))))
    test = e.rlike(r"\+test[^@]*@")
    return test | e.isin(admins) if admins else test
