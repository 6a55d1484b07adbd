"""Labels from paths and names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Canonical application labels, in the order in which they are tried, with their aliases.
APPLICATIONS = {
    "BROWSING": ("BROWSING", "BROWSER", "WEB"),
    "EMAIL": ("EMAIL", "MAIL"),
    "CHAT": ("CHAT", "IM", "MESSAGING"),
    "AUDIO": ("AUDIO", "AUDIOSTREAMING"),
    "VIDEO": ("VIDEO", "VIDEOSTREAMING", "STREAMING"),
    "FILE": ("FILE", "FTP", "FILETRANSFER", "TRANSFER"),
    "VOIP": ("VOIP", "VOICE", "SKYPE"),
    "P2P": ("P2P", "BITTORRENT", "TORRENT"),
}
# Candidates of the older decoder; the last that matches holds.
CANDIDATES = ("AUDIO", "CHAT", "FILE", "VIDEO", "VOIP", "BROWSING", "MAIL", "P2P", "STREAM", "SOCIAL", "GAMING")
# Traffic labels of the windowed features, those whose application is looked for, the application
# labels, and the label of each token.
TRAFFIC = ("VPN", "OTHER", "TOR", "QUIC")
ENCRYPTED = ("VPN", "TOR", "QUIC")
WINDOW_APPLICATIONS = ("AUDIO", "CHAT", "FILE", "VIDEO", "VOIP", "BROWSING", "MAIL", "P2P", "STREAM", "SOCIAL", "GAMING", "UNKNOWN")
TOKENS = {
    "CHAT": "CHAT", "ICQ": "CHAT", "WHATSAPP": "CHAT", "WECHAT": "CHAT", "QQ": "CHAT",
    "HANGOUT": "CHAT", "IRC": "CHAT", "IM": "CHAT", "MESSENGER": "CHAT",
    "VIDEO": "VIDEO", "VIMEO": "VIDEO", "YOUTUBE": "VIDEO", "NETFLIX": "VIDEO",
    "STREAM": "STREAM", "LIVE": "STREAM",
    "VOIP": "VOIP", "SIP": "VOIP", "CALL": "VOIP", "TELEPHONY": "VOIP", "SKYPE_VOIP": "VOIP", "VOIP_SKYPE": "VOIP",
    "AUDIO": "AUDIO", "SPOTIFY": "AUDIO", "MUSIC": "AUDIO", "MP3": "AUDIO",
    "FILE": "FILE", "FTP": "FILE", "FTPS": "FILE", "SFTP": "FILE", "DROPBOX": "FILE",
    "BITTORRENT": "P2P", "TORRENT": "P2P", "P2P": "P2P", "EMULE": "P2P",
    "BROWSING": "BROWSING", "HTTP": "BROWSING", "HTTPS": "BROWSING", "WEB": "BROWSING",
    "MAIL": "MAIL", "SMTP": "MAIL", "IMAP": "MAIL", "POP3": "MAIL", "GMAIL": "MAIL", "OUTLOOK": "MAIL",
    "SOCIAL": "SOCIAL", "FACEBOOK": "SOCIAL", "INSTAGRAM": "SOCIAL", "TWITTER": "SOCIAL",
    "GAMING": "GAMING", "GAME": "GAMING", "STEAM": "GAMING",
}
# Columns in which a packet table may name the application, in the order in which they are tried.
APPLICATION_COLUMNS = ("app_label", "application", "app", "appclass", "label_app")
# Substrings of the 20-feature generation's activity label, in the order in which they are tried.
ACTIVITIES = {
    "AUDIO": ("audio", "music", "voice"),
    "BROWSING": ("browsing", "web", "http"),
    "CHAT": ("chat", "message", "im"),
    "FILE": ("file", "download", "upload"),
    "VIDEO": ("video", "stream", "youtube"),
    "EMAIL": ("email", "mail"),
    "P2P": ("p2p", "torrent"),
    "VOIP": ("voip", "sip", "call"),
}


def stem(path: Column) -> Column:
    """The path with / between parts, upper case, without the last part's suffix."""
    return F.upper(F.regexp_replace(F.translate(path, "\\", "/"), r"(?<=[^/])\.[^./]+$", ""))


def tokens(path: Column) -> Column:
    return F.filter(F.split(stem(path), "[^A-Z0-9]+"), lambda x: x != "")


def compact(path: Column) -> Column:
    return F.regexp_replace(stem(path), "[^A-Z0-9]+", "")


def primary(path: Column) -> Column:
    has, text = lambda t: F.array_contains(tokens(path), t), compact(path)
    return (
        F.when(text.contains("NONTOR"), "NONTOR").when(has("TOR") | text.startswith("TOR"), "TOR").when(text.contains("NONVPN"), "NONVPN")
        .when(text.contains("VPN"), "VPN").when(has("QUIC"), "QUIC").otherwise("OTHER")
    )


def application(path: Column) -> Column:
    """The first canonical label with an alias that is a word of the path, or (four letters or more)
    is found anywhere in it."""
    out, text, words = None, compact(path), tokens(path)
    for label, aliases in APPLICATIONS.items():
        hit = F.arrays_overlap(words, F.array(*(F.lit(a) for a in aliases)))
        for a in aliases:
            if len(a) >= 4:
                hit = hit | text.contains(a)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("UNKNOWN")


def debug_traffic(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.contains("nonvpn"), "NONVPN").when(low.contains("vpn"), "VPN").otherwise("UNKNOWN")


def debug_application(path: Column) -> Column:
    """The last part of the path with a candidate, and the last candidate in it."""
    best = lambda part: F.coalesce(*(F.when(part.contains(c), F.lit(c)) for c in reversed(CANDIDATES)))
    found = F.filter(F.transform(F.split(F.upper(path), "/"), best), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("UNKNOWN"))


def _canonical(token: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in TOKENS.items() for x in pair)), token)


def secondary(path: Column) -> Column:
    """The label of the first token that has one: whole parts first, then words of the last part."""
    parts = F.split(F.upper(path), "/")
    words = F.concat(parts, F.split(F.element_at(parts, -1), "[^A-Z0-9]+"))
    found = F.filter(F.transform(words, _canonical), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("UNKNOWN"))


def cell_traffic(cell: Column) -> Column:
    """A table's own traffic label, where it is one."""
    return F.when(F.upper(cell).isin(*TRAFFIC), F.upper(cell))


def cell_application(*cells: Column) -> Column:
    """The application of the first cell that names one, as a label or a token."""
    name = lambda c: F.when(F.upper(c).isin(*WINDOW_APPLICATIONS), F.upper(c)).otherwise(_canonical(F.upper(c)))
    return F.coalesce(*(name(c) for c in cells))


def path_traffic(path: Column) -> Column:
    parts = F.split(F.upper(path), "/")
    return F.coalesce(*(F.when(F.array_contains(parts, t), F.lit(t)) for t in TRAFFIC), F.lit("OTHER"))


def file_labels(rows: DataFrame, source: str, path: str, order: list[str]) -> DataFrame:
    """(source, primary, secondary) of packet tables: the first row's label that is one, or else the path's;
    the application only where the traffic is encrypted, else UNKNOWN."""
    place = F.struct(*order)
    traffic = cell_traffic(F.col("traffic_label")) if "traffic_label" in rows.columns else F.lit(None).cast("string")
    cells = [F.col(c) for c in APPLICATION_COLUMNS if c in rows.columns]
    named = cell_application(*cells) if cells else F.lit(None).cast("string")
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), place))
    out = rows.groupBy(source).agg(first(traffic).alias("_t"), first(named).alias("_a"), F.min(path).alias("_p"))
    out = out.withColumn("primary", F.coalesce("_t", path_traffic(F.col("_p"))))
    return out.select(source, "primary", F.when(F.col("primary").isin(*ENCRYPTED), F.coalesce("_a", secondary(F.col("_p")))).otherwise("UNKNOWN").alias("secondary"))


def activity(name: Column) -> Column:
    low, out = F.lower(name), None
    for label, parts in ACTIVITIES.items():
        hit = low.rlike("|".join(parts))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("UNKNOWN")


def activity_class(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("vpn") & ~low.contains("nonvpn"), "VPN").otherwise("NONVPN")
