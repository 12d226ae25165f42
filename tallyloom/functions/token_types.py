"""The type of a shell token, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_W = r"[\p{L}\p{N}_]"
_WD = r"[\p{L}\p{N}_.-]"

#: What tokens of each type look like.
PATTERNS = {
    "folder": r"^(/|~)[\p{L}\p{N}_/-]+/?$",
    "file": rf"^(?:/[\p{{L}}\p{{N}}_/-]+|\.?/[\p{{L}}\p{{N}}_/-]+|{_WD}+)\.{_W}+$",
    "device": r"^/dev/[^\s]+$",
    "envfile": rf"^(?:\.|/)?{_WD}+\.(?:env|conf|ini)$",
    "script": rf"^\./{_WD}+\.sh$",
    "archive": rf"^{_WD}+\.(?:tar|gz|zip|bz2|xz)$",
    "ip": rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$",
    "ipv6": r"^([0-9a-fA-F]{0,4}:){1,7}[0-9a-fA-F]{0,4}$",
    "port": r"^[0-9]{1,5}$",
    "url": r"(?i)^https?://[^\s]+$",
    "remote_target": rf"^{_WD}+@{_WD}+(:/[\p{{L}}\p{{N}}_./-]*)?$",
    "domain": r"^(?:[a-zA-Z0-9][a-zA-Z0-9-]*\.)+(com|net|org|info|biz|name|xyz|online|site|tech|app|fr|us|uk|de|jp|io|edu|gov|mil)(?::[0-9]{1,5})?$",
    "dns_type": r"(?i)^(A|AAAA|MX|CNAME|TXT|NS|SOA|PTR|SRV|CAA)$",
    "port_range": r"^[0-9]{1,5}-[0-9]{1,5}$",
    "cidr": rf"^{_OCTET}(?:\.{_OCTET}){{3}}/(?:[0-9]|[12][0-9]|3[0-2])$",
    "word": r"^[a-zA-Z][a-zA-Z0-9_-]{0,19}$",
    "json": r"^\{.*\}$",
    "number": r"^-?[0-9]+(\.[0-9]+)?$",
}

#: The names of types in descriptions.
LABELS = {
    "file": "File", "folder": "Folder", "device": "Device", "envfile": "Environment file", "script": "Script", "archive": "Archive", "ip": "IP address", "ipv6": "IPv6 address", "port": "Port number",
    "url": "URL", "json": "JSON", "string": "String", "number": "Number", "remote_target": "Remote target", "arg": "Argument", "server": "Server", "http_method": "Http method", "domain": "Website / Domain",
    "dns_type": "DNS record type", "network_interface": "Network interface", "port_range": "Port range", "cidr": "Network (CIDR)", "gateway": "Gateway", "username": "Username", "python_module": "Python module",
}

#: Words that decide by themselves or by what stands before.
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD")
NETWORK_COMMANDS = ("ssh", "nc", "nmap", "telnet", "curl", "ftp")
PORT_AFTER = ("-p", "--port", "--listen-port", "--connect-port", "port", "http.server", "redis-cli -p")
TCPDUMP_VALUES = {"-i": "network_interface", "-w": "file"}
SERVERS = ("nginx", "apache")

#: What each token of a type contains, as far as it is always the same; this is looked for before the pattern is tried.
_NEEDS = {
    "file": ".", "device": "/dev/", "envfile": ".", "script": "./", "archive": ".", "ip": ".", "ipv6": ":", "url": "://", "remote_target": "@", "domain": ".", "port_range": "-", "cidr": "/", "json": "{",
}

#: Signs that no rule asks for.
_SIGNS = "!#$%&*,;<=>?|"
#: Most words of a text: they begin with a letter or such a sign and have no sign that a rule asks for, but for hyphens within and a full stop
#: that no letter or digit follows. Letters beyond ASCII are those of Latin-1 only, as others can become ASCII in upper or lower case.
_PLAIN = rf"\A[a-zA-ZÀ-ÿ{_SIGNS}][a-zA-Z0-9_À-ÿ{_SIGNS}-]*+(?:\.[{_SIGNS}]*+)?\z"
#: What rules name, in lower case.
_NAMED = ("gw", *SERVERS, *(m.lower() for m in HTTP_METHODS), "a", "aaaa", "mx", "cname", "txt", "ns", "soa", "ptr", "srv", "caa")
_LONG_NUMBER = r"\A[0-9]{6,}\z"


def is_quoted(t: Column) -> Column:
    return (F.length(t) > 0) & ((t.startswith("'") & t.endswith("'")) | (t.startswith('"') & t.endswith('"')))


def looks(t: Column, kind: str) -> Column:
    like = F.regexp_like(t, F.lit(PATTERNS[kind]))
    return t.contains(_NEEDS[kind]) & like if kind in _NEEDS else like


def token_type(token: Column, main: Column, previous: Column, index: Column) -> Column:
    """First match wins. previous is the element before, with its command (`tcpdump -i`), null if there is none."""
    return _by_rules(F.regexp_replace(token, r"^\s+|\s+$", ""), main, previous, index)


def word_type(token: Column, main: Column, previous: Column, index: Column) -> Column:
    """The same, for the many words of texts. For plain words no rule but the last can hold where command and place don't count, for long numbers
    only that of numbers; so these take one pattern each."""
    apart = (index != 0) & (token != main) & ~main.isin("python", "hydra", "tcpdump")
    plain = F.regexp_like(token, F.lit(_PLAIN)) & ~F.lower(token).isin(*_NAMED) & apart
    trimmed = F.regexp_replace(token, r"^\s+|\s+$", "")
    # within transform() the trimmed token is computed once, else once a rule
    ruled = F.element_at(F.transform(F.array(trimmed), lambda t: _by_rules(t, main, previous, index)), 1)
    return F.when(plain, "arg").when(F.regexp_like(token, F.lit(_LONG_NUMBER)) & apart, "number").otherwise(ruled)


def _by_rules(t: Column, main: Column, previous: Column, index: Column) -> Column:
    inner = F.when(F.length(t) > 1, F.substr(t, F.lit(2), F.length(t) - 2)).otherwise("")
    last = F.element_at(F.split(F.trim(previous), r"\s+"), -1)
    later = F.split(t, r"\s+")
    later_option = F.exists(F.slice(later, 2, F.greatest(F.size(later), F.lit(1))), lambda w: w.startswith("-"))
    ends = F.split(t, "-", 2)
    number = t.cast("string")
    port_like = F.coalesce(previous.isin(*PORT_AFTER), F.lit(False)) | (main.isin(*NETWORK_COMMANDS) & (number.try_cast("int").between(1, 65535)))
    out = (
        F.when(t == "", "arg").when(index == 0, "cmd").when(t == main, "cmd")
        .when(t.startswith(F.concat(main, F.lit(" "))), "cmdopt").when(t.contains(" ") & later_option, "cmdopt")
        .when(is_quoted(t), F.when(looks(inner, "json"), "json").when(looks(inner, "url"), "url").otherwise("string"))
        .when((main == "python") & (previous == "-m"), "python_module")
    )
    for kind in ("remote_target", "domain", "ip", "ipv6", "url", "cidr"):
        out = out.when(looks(t, kind), kind)
    out = (
        out.when(looks(t, "port_range") & (ends[0].try_cast("int") <= 65535) & (F.get(ends, F.lit(1)).try_cast("int") <= 65535), "port_range")
        .when(looks(t, "port"), F.when(port_like, "port").otherwise("number"))
        .when(looks(t, "number"), "number")
        .when((main == "tcpdump") & (last == "port"), "arg")
    )
    for option, kind in TCPDUMP_VALUES.items():
        out = out.when((main == "tcpdump") & (last == option), kind)
    out = (
        out.when(F.lower(t) == "gw", "gateway").when((main == "hydra") & (last == "-l"), "username").when(F.upper(t).isin(*HTTP_METHODS), "http_method")
        .when((main == "python") & F.trim(previous).endswith("-m"), "python_module").when(F.lower(t).isin(*SERVERS), "server")
        .when(looks(t, "word") & ~looks(t, "dns_type"), "arg")
    )
    for kind in ("folder", "file", "device", "envfile", "script", "archive"):
        out = out.when(looks(t, kind), kind)
    return out.when(t.startswith("-"), "option").otherwise("arg")


def type_label(kind: Column) -> Column:
    pairs = [F.lit(x) for kv in LABELS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), F.lit("Argument"))
