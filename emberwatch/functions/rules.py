"""Detection rules as column expressions.

Every rule set returns an array of (rule, reason) and a severity, the greatest of the rules that fire, 1 if none does.
Lists are parameters; the defaults below are fixed values that results depend on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LOLBINS = [
    "powershell", "cmd", "wscript", "cscript", "mshta", "regsvr32", "rundll32", "certutil", "bitsadmin", "msbuild",
    "nc", "ncat", "socat", "xxd", "base64", "nmap", "wget", "curl",
]
SUSPICIOUS_PATHS = ["\\temp\\", "\\downloads\\", "/tmp/", "/dev/shm/", "/var/tmp/"]
SUSPICIOUS_CMDLINE = [
    "-enc", "-encodedcommand", "-nop", "-noprofile", "-w hidden", "-windowstyle hidden", "iex", "invoke-expression",
    "downloadstring", "frombase64string", "| sh", "|sh", "| bash", "|bash", "-urlcache", "-decode",
]
SUSPICIOUS_PORTS = [4444, 4445, 1337, 31337, 12345, 6667, 6697, 5555, 9001]
WATCH = [
    "\\windows\\system32\\", "\\program files\\", "\\start menu\\programs\\startup\\", "\\system32\\tasks\\",
    "\\system32\\config\\", "\\drivers\\etc\\hosts", "/usr/bin/", "/usr/sbin/", "/bin/", "/sbin/", "/etc/", ".ssh/",
    "/etc/cron", "/etc/systemd/", "/etc/init.d/", "/etc/rc.local",
]
IGNORE = [
    "\\appdata\\local\\temp\\", "/tmp/", "\\temp\\", "\\ebwebview\\", "\\cache\\", "\\logfiles\\", ".etl", ".log",
    "/proc/", "/sys/", "/dev/",
]
SYSTEM_DIRS = ["\\windows\\system32\\", "\\program files\\", "/usr/bin/", "/usr/sbin/", "/bin/", "/sbin/"]
PERSISTENCE = ["\\start menu\\programs\\startup\\", "\\system32\\tasks\\", "/etc/cron", "/etc/systemd/", "/etc/init.d/", "/etc/rc.local"]
SENSITIVE_CONFIG = ["/etc/", ".ssh/", "\\system32\\config\\", "\\drivers\\etc\\hosts"]
SENSITIVE_READ = ["/etc/shadow", ".ssh/id_", "\\system32\\config\\sam", "/etc/sudoers"]
SEVERITY = {
    "lolbin": 3, "suspicious_path": 3, "lolbin_in_suspicious_path": 4, "lolbin_suspicious_cmdline": 4,
    "short_lived_suspicious": 3, "suspicious_port": 3, "suspicious_port_to_external": 4, "write_to_system_dir": 4,
    "write_to_persistence_location": 4, "write_to_sensitive_config": 4, "read_of_sensitive_file": 3,
}
SHORT_LIVED_MS = 500

HITS = "array<struct<rule:string,reason:string>>"
#: The rule of a process that is suspicious by an ancestor.
ANCESTOR = "suspicious_ancestor"


def any_of(text: Column, needles: list[str]) -> Column:
    """Whether the text holds one of the needles; a chain of contains() stays in generated code."""
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return F.coalesce(out, F.lit(False))


def first_of(text: Column, needles: list[str]) -> Column:
    """The first needle, in list order, that the text holds."""
    return F.coalesce(*[F.when(text.contains(n), F.lit(n)) for n in needles])


def hits(*rules: tuple[Column, str, Column]) -> Column:
    """Array of (rule, reason) of the rules whose condition holds."""
    found = [F.when(cond, F.struct(F.lit(rule).alias("rule"), reason.alias("reason"))) for cond, rule, reason in rules]
    return F.array_compact(F.array(*found))


def let(value: Column, of) -> Column:
    """`of` of a value that is worked out once, however often `of` uses it: keeps nested expressions small."""
    return F.get(F.transform(F.array(value), lambda v: of(v)), F.lit(0))


def severity(found: Column) -> Column:
    def level(h: Column) -> Column:
        out = F.lit(1)
        for at in sorted(set(SEVERITY.values())):
            out = F.when(h["rule"].isin([r for r, s in SEVERITY.items() if s == at]), at).otherwise(out)
        return out

    return F.coalesce(F.array_max(F.transform(found, lambda h: level(h))), F.lit(1)).cast("short")


def basename(image: Column) -> Column:
    """After the last slash of either kind, lower case, without `.exe`."""
    return F.regexp_replace(F.lower(F.regexp_extract(image, r"([^\\/]*)\z", 1)), r"\.exe\z", "")


def process_hits(image: Column, cmdline: Column | None = None, trusted: Column | None = None) -> Column:
    """Dual-use binaries, suspicious directories (unless trusted), both together, and suspicious command lines."""
    image = F.coalesce(image, F.lit(""))
    base, low = basename(image), F.lower(image)
    lolbin = base.isin(LOLBINS)
    where = first_of(low, SUSPICIOUS_PATHS)
    if trusted is not None:
        where = F.when(~F.coalesce(trusted, F.lit(False)), where)
    rules = [
        (lolbin, "lolbin", F.concat(F.lit("dual-use binary "), base)),
        (where.isNotNull(), "suspicious_path", F.concat(F.lit("image in suspicious directory "), where)),
        (lolbin & where.isNotNull(), "lolbin_in_suspicious_path", F.concat(F.lit("dual-use binary "), base, F.lit(" in suspicious directory "), where)),
    ]
    if cmdline is not None:
        token = first_of(F.lower(cmdline), SUSPICIOUS_CMDLINE)
        rules.append((lolbin & token.isNotNull(), "lolbin_suspicious_cmdline", F.concat(F.lit("dual-use binary "), base, F.lit(" with argument "), token)))
    return hits(*rules)


def image_severity(image: Column) -> Column:
    """Severity by the image alone, without building the hits."""
    image = F.coalesce(image, F.lit(""))
    lolbin, path = basename(image).isin(LOLBINS), any_of(F.lower(image), SUSPICIOUS_PATHS)
    return F.when(lolbin & path, 4).when(lolbin | path, 3).otherwise(1).cast("short")


def short_lived(image: Column, lifetime_ms: Column) -> Column:
    """An image that is suspicious by itself and exits in less than SHORT_LIVED_MS."""
    return F.coalesce((image_severity(image) > 1) & (lifetime_ms < SHORT_LIVED_MS), F.lit(False))


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"


def _v4_octets(text: Column) -> Column:
    return F.transform(F.split(text, r"\."), lambda o: o.cast("int"))


def _v4_local(o: Column) -> Column:
    a, b = F.get(o, 0), F.get(o, 1)
    return (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a == 127) | ((a == 169) & (b == 254)) | F.forall(o, lambda x: x == 0)


def _v6_segments(text: Column) -> Column:
    """Eight integers, or null for what is no IPv6 address. A double colon stands for one segment at least."""
    group = r"[0-9A-Fa-f]{1,4}"
    shape = rf"\A(?:{group}(?::{group})*)?(?:::)?(?:{group}(?::{group})*)?\z"
    as_hex = lambda o: F.concat(F.hex(F.get(o, 0) * 256 + F.get(o, 1)), F.lit(":"), F.hex(F.get(o, 2) * 256 + F.get(o, 3)))
    dotted = F.regexp_extract(text, rf"({_OCTET}(?:\.{_OCTET}){{3}})\z", 1)
    plain = let(dotted, lambda d: F.when(d != "", F.concat(F.substr(text, F.lit(1), F.length(text) - F.length(d)), let(_v4_octets(d), as_hex))).otherwise(text))
    ints = lambda s: F.when(s == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(s, ":"), lambda g: F.conv(g, 16, 10).cast("int")))

    def filled(halves: Column) -> Column:
        left, right = F.get(halves, 0), F.get(halves, 1)
        gap = 8 - F.size(left) - F.coalesce(F.when(F.size(halves) == 2, F.size(right)), F.lit(0))
        return F.when(F.size(halves) == 1, F.when(gap == 0, left)).when((F.size(halves) == 2) & (gap >= 1), F.concat(left, F.array_repeat(F.lit(0), gap), right))

    return let(plain, lambda p: F.when(p.rlike(shape), let(F.transform(F.split(p, "::", -1), ints), filled)))


def _v6_local(s: Column) -> Column:
    first = F.get(s, 0)
    return (F.forall(F.slice(s, 1, 7), lambda x: x == 0) & F.get(s, 7).isin(0, 1)) | first.between(0xFE80, 0xFEBF) | first.between(0xFC00, 0xFDFF)


def is_external(addr: Column) -> Column:
    """Public address: v4 that isn't private, loopback, link-local or unspecified; v6 that isn't loopback, unspecified,
    link-local or unique-local; a mapped v4 as that v4. What doesn't parse is not external."""
    mapped = lambda s: F.forall(F.slice(s, 1, 5), lambda x: x == 0) & (F.get(s, 5) == 0xFFFF)
    inner = lambda s: F.array(F.shiftright(F.get(s, 6), 8), F.get(s, 6) % 256, F.shiftright(F.get(s, 7), 8), F.get(s, 7) % 256)
    v6 = let(_v6_segments(addr), lambda s: F.when(s.isNotNull(), ~F.when(mapped(s), let(inner(s), _v4_local)).otherwise(_v6_local(s))))
    v4 = let(_v4_octets(addr), lambda o: ~_v4_local(o))
    return F.coalesce(F.when(addr.rlike(_V4), v4).when(addr.contains(":"), v6), F.lit(False))


def is_loopback(addr: Column) -> Column:
    v6 = let(_v6_segments(addr), lambda s: F.forall(F.slice(s, 1, 7), lambda x: x == 0) & (F.get(s, 7) == 1))
    return F.coalesce(F.when(addr.rlike(_V4), F.get(_v4_octets(addr), 0) == 127).when(addr.contains(":"), v6), F.lit(False))


def connection_scope(addr: Column) -> Column:
    """loopback, external or private; null for what doesn't parse."""
    parses = addr.rlike(_V4) | _v6_segments(addr).isNotNull()
    return F.when(is_loopback(addr), "loopback").when(is_external(addr), "external").when(parses, "private")


def network_hits(daddr: Column, dport: Column) -> Column:
    port = dport.isin(SUSPICIOUS_PORTS)
    return hits(
        (port, "suspicious_port", F.concat(F.lit("suspicious destination port "), dport.cast("string"))),
        (port & is_external(daddr), "suspicious_port_to_external", F.concat(F.lit("suspicious port "), dport.cast("string"), F.lit(" at external address "), daddr)),
    )


def network_severity(daddr: Column, dport: Column) -> Column:
    port = F.coalesce(dport.isin(SUSPICIOUS_PORTS), F.lit(False))
    return F.when(port, F.when(is_external(daddr), 4).otherwise(3)).otherwise(1).cast("short")


def watched(path: Column, watch: list[str] = WATCH, ignore: list[str] = IGNORE) -> Column:
    """The prefilter of file events: a watched part and no ignored one; ignored parts with a leading dot are endings."""
    low = F.lower(path)
    drop = any_of(low, [i for i in ignore if not i.startswith(".")])
    for i in ignore:
        if i.startswith("."):
            drop = drop | low.endswith(i)
    return F.coalesce(any_of(low, watch) & ~drop, F.lit(False))


def file_hits(path: Column, write: Column) -> Column:
    low = F.lower(path)
    return hits(
        (write & any_of(low, SYSTEM_DIRS), "write_to_system_dir", F.concat(F.lit("write to a system directory: "), path)),
        (write & any_of(low, PERSISTENCE), "write_to_persistence_location", F.concat(F.lit("write to an autostart location: "), path)),
        (write & any_of(low, SENSITIVE_CONFIG), "write_to_sensitive_config", F.concat(F.lit("write to sensitive configuration: "), path)),
        (~write & any_of(low, SENSITIVE_READ), "read_of_sensitive_file", F.concat(F.lit("read of a secret file: "), path)),
    )


def is_shared_library(path: Column, packaged: bool = False) -> Column:
    """`.so`, `.dll` or a versioned `.so.`; in package lists also `.dylib`."""
    base = F.lower(F.regexp_extract(path, r"([^\\/]*)\z", 1))
    out = base.endswith(".so") | base.endswith(".dll") | base.contains(".so.")
    return F.coalesce(out | base.endswith(".dylib") if packaged else out, F.lit(False))
