"""Whether an import names something that the language's own runtime ships, as a Column. Asked after resolution has failed."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Crates of the Rust toolchain.
RUST = ("std", "core", "alloc", "proc_macro", "test")
# First segments of JVM runtime packages, and second segments of javax packages in the JDK.
JVM = ("java", "kotlin", "sun", "jdk")
JAVAX = ("accessibility", "crypto", "imageio", "lang", "management", "naming", "net", "print", "rmi", "script", "security", "smartcardio", "sound", "sql", "swing", "tools", "xml")
# Modules that Python has had and dropped (the others are asked from the interpreter).
PYTHON_PAST = (
    "aifc", "asynchat", "asyncore", "audioop", "cgi", "cgitb", "chunk", "crypt", "distutils", "imghdr", "imp", "lib2to3", "mailcap", "msilib", "nis", "nntplib", "ossaudiodev", "pipes", "smtpd",
    "sndhdr", "spwd", "sunau", "telnetlib", "uu", "xdrlib",
)
# Modules of Node.
NODE = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events", "fs", "http", "http2", "https",
    "inspector", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "sys", "timers", "tls", "trace_events", "tty",
    "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib", "test", "sqlite",
)
# Headers of C, POSIX and Windows that end in .h, and Apple's frameworks.
C_HEADERS = (
    "assert.h", "complex.h", "ctype.h", "errno.h", "fenv.h", "float.h", "inttypes.h", "iso646.h", "limits.h", "locale.h", "math.h", "setjmp.h", "signal.h", "stdalign.h", "stdarg.h",
    "stdatomic.h", "stdbit.h", "stdbool.h", "stdckdint.h", "stddef.h", "stdint.h", "stdio.h", "stdlib.h", "stdnoreturn.h", "string.h", "tgmath.h", "threads.h", "time.h", "uchar.h", "wchar.h",
    "wctype.h", "aio.h", "cpio.h", "dirent.h", "dlfcn.h", "fcntl.h", "fmtmsg.h", "fnmatch.h", "ftw.h", "glob.h", "grp.h", "iconv.h", "langinfo.h", "libgen.h", "monetary.h", "mqueue.h", "ndbm.h",
    "netdb.h", "nl_types.h", "poll.h", "pthread.h", "pwd.h", "regex.h", "sched.h", "search.h", "semaphore.h", "spawn.h", "strings.h", "stropts.h", "syslog.h", "tar.h", "termios.h", "ucontext.h",
    "ulimit.h", "unistd.h", "utime.h", "utmpx.h", "wordexp.h", "windows.h", "winsock2.h", "ws2tcpip.h", "tchar.h", "io.h", "process.h", "direct.h",
)
FRAMEWORKS = (
    "Foundation", "UIKit", "AppKit", "CoreData", "CoreFoundation", "CoreGraphics", "CoreLocation", "CoreAnimation", "CoreText", "CoreImage", "CoreMedia", "CoreAudio", "CoreBluetooth", "CoreML",
    "CoreVideo", "QuartzCore", "AVFoundation", "WebKit", "MapKit", "StoreKit", "SwiftUI", "Combine", "Security", "SystemConfiguration", "UserNotifications", "XCTest", "Metal", "MetalKit", "SceneKit",
    "SpriteKit", "Photos", "PhotosUI", "Contacts", "EventKit", "HealthKit", "HomeKit", "ARKit", "CloudKit", "LocalAuthentication", "Network", "OSLog", "os", "sys", "mach", "objc", "dispatch", "simd",
)
# What Ruby ships, by the whole require path.
RUBY = (
    "abbrev", "base64", "benchmark", "bigdecimal", "cgi", "coverage", "csv", "date", "delegate", "digest", "drb", "English", "erb", "etc", "expect", "fcntl", "fiddle", "fileutils", "find",
    "forwardable", "getoptlong", "ipaddr", "json", "logger", "mkmf", "monitor", "mutex_m", "objspace", "observer", "open-uri", "open3", "openssl", "optparse", "ostruct", "pathname", "pp",
    "prettyprint", "prime", "pstore", "psych", "pty", "racc", "rbconfig", "readline", "resolv", "resolv-replace", "rexml", "rinda", "ripper", "rss", "rubygems", "securerandom", "set", "shellwords",
    "singleton", "socket", "stringio", "strscan", "syslog", "tempfile", "time", "timeout", "tmpdir", "tsort", "un", "uri", "weakref", "yaml", "zlib", "debug", "did_you_mean", "error_highlight",
    "irb", "reline", "syntax_suggest", "cgi/cookie", "cgi/escape", "cgi/session", "cgi/util", "digest/bubblebabble", "digest/md5", "digest/rmd160", "digest/sha1", "digest/sha2", "drb/drb",
    "drb/ssl", "drb/unix", "io/console", "io/nonblock", "io/wait", "json/add/core", "json/common", "net/ftp", "net/http", "net/https", "net/imap", "net/pop", "net/protocol", "net/smtp",
    "openssl/digest", "openssl/ssl", "openssl/x509", "psych/visitors", "rexml/document", "rexml/parsers/pullparser", "rexml/streamlistener", "rubygems/package", "rubygems/version", "uri/common",
    "uri/generic", "uri/http", "yaml/store", "minitest/autorun", "minitest/test", "test/unit",
)
# Second segments of Microsoft namespaces in the .NET runtime, and modules of PowerShell itself.
DOTNET = ("Win32", "CSharp", "VisualBasic")
POWERSHELL = (
    "microsoft.powershell.core", "microsoft.powershell.management", "microsoft.powershell.utility", "microsoft.powershell.security", "microsoft.powershell.host",
    "microsoft.powershell.diagnostics", "microsoft.powershell.archive", "microsoft.wsman.management", "cimcmdlets", "psdiagnostics",
)


def python_modules() -> tuple[str, ...]:
    return (*(m for m in sorted(sys.stdlib_module_names) if not m.startswith("_") or m == "__future__"), *PYTHON_PAST)


def jvm(raw: Column) -> Column:
    """java, kotlin, sun, jdk, com.sun and the JDK's own part of javax."""
    part = F.split(raw, r"\.")
    first, second = F.get(part, F.lit(0)), F.coalesce(F.get(part, F.lit(1)), F.lit(""))
    return first.isin(*JVM) | ((first == "com") & (second == "sun")) | ((first == "javax") & second.isin(*JAVAX))


def c_header(raw: Column) -> Column:
    """An angled include without extension, of C's own headers, or of an Apple framework; a quoted one never is."""
    inc = F.regexp_extract(raw, "^<([^>]*)>?$", 1)
    first, base = F.split(inc, "/")[0], F.regexp_extract(inc, "([^/]*)$", 1)
    below = F.when(inc.contains("/"), first.isin(*FRAMEWORKS) | inc.isin("arpa/inet.h", "net/if.h")).otherwise(inc.isin(*C_HEADERS))
    return (inc != "") & (~base.contains(".") | below)


def dotnet(raw: Column) -> Column:
    part = F.split(raw, r"\.")
    return (part[0] == "System") | ((part[0] == "Microsoft") & F.coalesce(F.get(part, F.lit(1)), F.lit("")).isin(*DOTNET))


def powershell(raw: Column) -> Column:
    return (raw.contains(".") & dotnet(raw)) | F.lower(raw).isin(*POWERSHELL)


def ships(lang: Column, raw: Column) -> Column:
    """Whether ``raw``, imported in ``lang``, is the runtime's own. PHP and the shell have no imports of their own runtime."""
    return (
        F.when(lang == "go", ~F.split(raw, "/")[0].contains("."))
        .when(lang == "rust", F.split(raw, "::")[0].isin(*RUST))
        .when(lang == "python", F.split(raw, r"\.")[0].isin(*python_modules()))
        .when(lang.isin("java", "kotlin"), jvm(raw))
        .when(lang.isin("c", "cpp", "objc"), c_header(raw))
        .when(lang == "ruby", F.regexp_replace(raw, r"\.rb$", "").isin(*RUBY))
        .when(lang == "csharp", dotnet(raw))
        .when(lang == "powershell", powershell(raw))
        .when(lang.isin("typescript", "javascript", "vue", "svelte", "astro"), F.split(F.regexp_replace(raw, "^node:", ""), "/")[0].isin(*NODE))
        .otherwise(F.lit(False))
    )
