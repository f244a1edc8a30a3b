"""The settings of a crawl, and their reading from rc files and command lines."""

from __future__ import annotations

import dataclasses
import re
from dataclasses import dataclass, field

BOOLEANS = {"on": True, "yes": True, "true": True, "1": True, "off": False, "no": False, "false": False, "0": False}


class ConfigError(ValueError):
    """A setting that does not parse or is not known."""


@dataclass
class CrawlConfig:
    # what to fetch
    urls: list[str] = field(default_factory=list)
    input_file: str | None = None
    base: str | None = None
    force_html: bool = False
    force_css: bool = False
    force_rss: bool = False
    force_atom: bool = False
    force_sitemap: bool = False
    force_metalink: bool = False
    input_metalink: str | None = None
    metalink_index: int = 0
    metalink_over_http: bool = False
    preferred_location: str | None = None
    keep_badhash: bool = False
    # recursion
    recursive: bool = False
    level: int = 5
    page_requisites: bool = False
    span_hosts: bool = False
    no_parent: bool = False
    relative_only: bool = False
    follow_ftp: bool = False
    follow_sitemaps: bool = True
    strict_comments: bool = False
    delete_after: bool = False
    convert_links: bool = False
    convert_file_only: bool = False
    # accept and reject
    accept: list[str] = field(default_factory=list)
    reject: list[str] = field(default_factory=list)
    accept_regex: str | None = None
    reject_regex: str | None = None
    regex_type: str = "posix"
    ignore_case: bool = False
    domains: list[str] = field(default_factory=list)
    exclude_domains: list[str] = field(default_factory=list)
    include_directories: list[str] = field(default_factory=list)
    exclude_directories: list[str] = field(default_factory=list)
    follow_tags: list[str] = field(default_factory=list)
    ignore_tags: list[str] = field(default_factory=list)
    filter_mime_type: list[str] = field(default_factory=list)
    https_only: bool = False
    iri: bool = True
    rejected_log: str | None = None
    # limits
    quota: int | None = None
    tries: int = 20
    wait: float = 0.0
    random_wait: bool = False
    waitretry: float = 10.0
    max_redirect: int = 20
    retry_on_host_error: bool = False
    retry_on_http_error: list[int] = field(default_factory=list)
    content_on_error: bool = False
    ignore_length: bool = False
    limit_rate: int | None = None
    max_threads: int = 1
    max_threads_per_host: int = 1
    timeout: float | None = None
    connect_timeout: float | None = None
    read_timeout: float | None = None
    dns_timeout: float | None = None
    # names
    directory_prefix: str = "."
    directories: bool = True
    force_directories: bool = False
    host_directories: bool = True
    protocol_directories: bool = False
    cut_dirs: int = 0
    default_page: str = "index.html"
    output_document: str | None = None
    no_clobber: bool = False
    unique_names: bool = False
    continue_download: bool = False
    start_pos: int | None = None
    backups: int = 0
    timestamping: bool = False
    if_modified_since: bool = True
    use_server_timestamps: bool = True
    adjust_extension: bool = False
    content_disposition: bool = False
    trust_server_names: bool = False
    restrict_file_names: list[str] = field(default_factory=lambda: ["unix"])
    cut_url_get_vars: list[str] | None = None
    cut_file_get_vars: list[str] | None = None
    local_encoding: str | None = None
    remote_encoding: str | None = None
    save_headers: bool = False
    keep_listing: bool = False
    spider: bool = False
    # archives
    warc_file: str | None = None
    warc_max_size: int | None = None
    warc_cdx: bool = False
    warc_dedup: str | None = None
    warc_compression: bool = True
    warc_digests: bool = True
    warc_keep_log: bool = True
    warc_headers: list[str] = field(default_factory=list)
    # transport
    user_agent: str = "webloom/1"
    headers: list[str] = field(default_factory=list)
    referer: str | None = None
    method: str | None = None
    body_data: str | None = None
    post_data: str | None = None
    user: str | None = None
    password: str | None = None
    http_user: str | None = None
    http_password: str | None = None
    ftp_user: str | None = None
    ftp_password: str | None = None
    netrc: bool = True
    cookies: bool = True
    load_cookies: str | None = None
    save_cookies: str | None = None
    keep_session_cookies: bool = False
    hsts: bool = True
    hsts_file: str | None = None
    use_proxy: bool = True
    no_proxy: str = ""
    check_certificate: bool = True
    passive_ftp: bool = True
    ftp_glob: bool = True
    ftps_implicit: bool = False
    ftps_resume_ssl: bool = True
    ftps_clear_data_connection: bool = False
    ftps_fallback_to_ftp: bool = False
    bind_address: str | None = None
    # talk
    verbose: bool = True
    quiet: bool = False
    debug: bool = False
    logfile: str | None = None

    def mirrored(self) -> CrawlConfig:
        """The mirror preset."""
        return dataclasses.replace(self, recursive=True, level=-1, timestamping=True, keep_listing=True)


def parse_bool(value: str) -> bool:
    try:
        return BOOLEANS[value.strip().lower()]
    except KeyError:
        raise ConfigError(f"not a switch: {value}") from None


def parse_bytes(value: str) -> int:
    m = re.fullmatch(r"\s*([0-9]+)\s*([kmgt]?)b?\s*", value.lower())
    if not m:
        raise ConfigError(f"not a size: {value}")
    return min(2**63 - 1, int(m[1]) * 1024 ** " kmgt".index(m[2] or " "))


def parse_seconds(value: str) -> float:
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*([smhd]?)\s*", value.lower())
    if not m:
        raise ConfigError(f"not a duration: {value}")
    return float(m[1]) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]]


def parse_tries(value: str) -> int:
    return 0 if value.strip().lower() == "inf" else _int(value)


def parse_level(value: str) -> int:
    """Of a command line: 0 and inf are no limit."""
    n = -1 if value.strip().lower() == "inf" else _int(value)
    return -1 if n == 0 else n


def _rc_level(value: str) -> int:
    return -1 if value.strip().lower() == "inf" else _int(value)


def _int(value: str) -> int:
    try:
        return int(value)
    except ValueError:
        raise ConfigError(f"not a number: {value}") from None


def split_list(value: str) -> list[str]:
    return [x.strip() for x in value.split(",") if x.strip()]


#: rc keys (lower case, without - and _) by how their value is read, and the field if its
#: name differs.  Fixed values: the names are a file format.
RC = (
    {k: (parse_bool, k) for k in ("verbose", "quiet", "debug", "recursive", "timestamping", "spider", "hsts", "cookies", "netrc", "iri")}
    | {
        "continue": (parse_bool, "continue_download"), "alwaysrest": (parse_bool, "continue_download"), "noclobber": (parse_bool, "no_clobber"), "checkcertificate": (parse_bool, "check_certificate"),
        "httpsonly": (parse_bool, "https_only"), "convertlinks": (parse_bool, "convert_links"), "pagerequisites": (parse_bool, "page_requisites"), "spanhosts": (parse_bool, "span_hosts"), "noparent": (parse_bool, "no_parent"),
        "useproxy": (parse_bool, "use_proxy"), "passiveftp": (parse_bool, "passive_ftp"), "adjustextension": (parse_bool, "adjust_extension"), "htmlextension": (parse_bool, "adjust_extension"),
        "contentdisposition": (parse_bool, "content_disposition"), "saveheaders": (parse_bool, "save_headers"), "useservertimestamps": (parse_bool, "use_server_timestamps"), "ifmodifiedsince": (parse_bool, "if_modified_since"),
        "tries": (parse_tries, "tries"), "numtries": (parse_tries, "tries"), "wait": (parse_seconds, "wait"), "waitretry": (parse_seconds, "waitretry"), "dnstimeout": (parse_seconds, "dns_timeout"),
        "connecttimeout": (parse_seconds, "connect_timeout"), "readtimeout": (parse_seconds, "read_timeout"), "limitrate": (parse_bytes, "limit_rate"), "quota": (parse_bytes, "quota"), "reclevel": (_rc_level, "level"), "maxredirect": (_int, "max_redirect"),
        "dirprefix": (str, "directory_prefix"), "useragent": (str, "user_agent"), "logfile": (str, "logfile"), "outputdocument": (str, "output_document"), "httpuser": (str, "http_user"), "httppassword": (str, "http_password"), "httppasswd": (str, "http_password"),
        "ftpuser": (str, "ftp_user"), "ftppassword": (str, "ftp_password"), "ftppasswd": (str, "ftp_password"), "user": (str, "user"), "password": (str, "password"), "localencoding": (str, "local_encoding"), "remoteencoding": (str, "remote_encoding"),
        "bindaddress": (str, "bind_address"), "base": (str, "base"),
    }
)


def apply_rc(config: CrawlConfig, line: str) -> CrawlConfig:
    """One rc line; blank lines and ``#`` comments change nothing."""
    line = line.strip()
    if not line or line.startswith("#"):
        return config
    key, mark, value = line.partition("=")
    if not mark:
        raise ConfigError(f"no '=' in: {line}")
    name, value = re.sub("[-_]", "", key.strip().lower()), value.strip()
    if name == "robots":  # robots rules always hold in recursion
        return config
    if name == "timeout":
        t = parse_seconds(value)
        return dataclasses.replace(config, timeout=t, connect_timeout=t, read_timeout=t, dns_timeout=t)
    if name == "mirror" and parse_bool(value):
        return config.mirrored()
    if name not in RC:
        raise ConfigError(f"unknown setting: {name}")
    read, attribute = RC[name]
    out = dataclasses.replace(config, **{attribute: read(value)})
    return dataclasses.replace(out, unique_names=False) if name == "noclobber" and out.no_clobber else out


def load_rc(config: CrawlConfig, texts: list[str]) -> CrawlConfig:
    for text in texts:
        for line in text.splitlines():
            config = apply_rc(config, line)
    return config


#: Command-line options whose name is not the field's with dashes.
RENAMED = {
    "continue": "continue_download", "input-file": "input_file", "level": "level", "no-parent": "no_parent", "relative": "relative_only", "accept-regex": "accept_regex", "directory-prefix": "directory_prefix", "save-headers": "save_headers",
    "cut-url-get-vars": "cut_url_get_vars", "cut-file-get-vars": "cut_file_get_vars", "header": "headers", "warc-header": "warc_headers", "bind-address": "bind_address", "keep-listing": "keep_listing", "no-proxy": "no_proxy",
}
SHORT = {
    "a": "append-output", "o": "output-file", "d": "debug", "q": "quiet", "v": "verbose", "i": "input-file", "F": "force-html", "B": "base", "t": "tries", "O": "output-document", "c": "continue", "N": "timestamping", "T": "timeout", "w": "wait", "Q": "quota",
    "x": "force-directories", "P": "directory-prefix", "r": "recursive", "l": "level", "k": "convert-links", "m": "mirror", "p": "page-requisites", "A": "accept", "R": "reject", "D": "domains", "L": "relative", "I": "include-directories", "X": "exclude-directories",
    "H": "span-hosts", "U": "user-agent", "S": "server-response", "E": "adjust-extension", "e": "execute", "4": "inet4-only", "6": "inet6-only", "np": "no-parent", "nc": "no-clobber", "nd": "no-directories", "nH": "no-host-directories", "nv": "no-verbose",
}
APPENDED = {"headers", "warc_headers", "filter_mime_type"}


def parse_args(argv: list[str], config: CrawlConfig | None = None) -> CrawlConfig:
    """Options and URLs; ``-e`` commands are applied last.  Lists given again replace
    those before, but headers and MIME types add up.  ``--`` ends the options."""
    config = config or CrawlConfig()
    fields = {f.name: f for f in dataclasses.fields(CrawlConfig)}
    values: dict[str, object] = {}
    late: list[str] = []
    found: list[str] = []
    left = list(argv)

    def take(inline: str | None, option: str) -> str:
        if inline is not None:
            return inline
        if not left:
            raise ConfigError(f"{option} needs a value")
        return left.pop(0)

    def one(option: str, inline: str | None) -> None:
        nonlocal config
        if option == "execute":
            late.append(take(inline, option))
            return
        if option == "mirror":
            config = config.mirrored()
            return
        if option == "timeout":
            late.append(f"timeout={take(inline, option)}")
            return
        positive, name = True, RENAMED.get(option, option.replace("-", "_"))
        if name not in fields and option.startswith("no-"):
            positive, name = False, RENAMED.get(option[3:], option[3:].replace("-", "_"))
        if name not in fields:
            raise ConfigError(f"unknown option: {option}")
        kind, now = str(fields[name].type), getattr(config, name)
        if kind == "bool":
            values[name] = positive if inline is None else parse_bool(inline)
            return
        text = take(inline, option)
        if name in ("quota", "limit_rate", "warc_max_size", "start_pos"):
            values[name] = parse_bytes(text)
        elif name == "tries":
            values[name] = parse_tries(text)
        elif name == "level":
            values[name] = parse_level(text)
        elif kind.startswith("float"):
            values[name] = parse_seconds(text)
        elif kind.startswith("int"):
            values[name] = _int(text)
        elif "list" in kind:
            new = [text] if name in ("headers", "warc_headers") else split_list(text)
            new = [int(x) for x in new] if "int" in kind else new
            values[name] = [*values.get(name, now or []), *new] if name in APPENDED else new
        else:
            values[name] = text

    while left:
        arg = left.pop(0)
        if arg == "--":
            found += left
            break
        if arg.startswith("--"):
            option, mark, inline = arg[2:].partition("=")
            one(option, inline if mark else None)
        elif arg.startswith("-") and len(arg) > 1:
            if arg[1:] in SHORT:
                one(SHORT[arg[1:]], None)
                continue
            rest = arg[1:]
            while rest:
                if rest[0] not in SHORT:
                    raise ConfigError(f"unknown option: -{rest[0]}")
                option, rest = SHORT[rest[0]], rest[1:]
                name = RENAMED.get(option, option.replace("-", "_"))
                takes = option in ("execute", "timeout") or (name in fields and str(fields[name].type) != "bool")
                one(option, rest if takes and rest else None)
                if takes:
                    break
        else:
            found.append(arg)
    out = dataclasses.replace(config, **values, urls=[*config.urls, *found])
    threads = min(32, max(1, out.max_threads))
    out = dataclasses.replace(out, max_threads=threads, max_threads_per_host=out.max_threads_per_host if "max_threads_per_host" in values else min(threads, 4))
    for line in late:
        out = apply_rc(out, line)
    return out
