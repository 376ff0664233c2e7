"""Classification rules, each one CASE expression. Texts and thresholds are fixed values of the rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsledger.functions.text import contains_any


# Three different meanings of "the server answers", told by its HTTP code.
def http_up(code: Column) -> Column:
    """Up: success, redirect, or asking for a login; a missing code is down."""
    return F.coalesce(code.between(200, 399) | code.isin(401, 403), F.lit(False))


def http_status(code: Column) -> Column:
    """CONNECTED, ERROR, or DISCONNECTED without a code."""
    return F.when(code.isNull(), "DISCONNECTED").when(code.between(200, 299) | (code == 401), "CONNECTED").otherwise("ERROR")


def http_ok(code: Column) -> Column:
    """Exactly 200."""
    return F.coalesce(code == 200, F.lit(False))


def memory_tier(memory_class: Column) -> Column:
    """low up to 128 MB, medium up to 256, else high."""
    return F.when(memory_class <= 128, "low").when(memory_class <= 256, "medium").otherwise("high")


def tuning(memory_class: Column) -> Column:
    """map of cache and speed parameters by memory tier."""
    tier = memory_tier(memory_class)
    # Directory cache MB, content cache MB, download Mbps.
    rows = {"low": ("100", "50", "5"), "medium": ("200", "100", "10"), "high": ("500", "250", "20")}
    maps = {k: F.create_map(F.lit("cache_directory_size_mb"), F.lit(a), F.lit("content_cache_size_mb"), F.lit(b), F.lit("max_download_speed_mbps"), F.lit(c)) for k, (a, b, c) in rows.items()}
    return F.when(tier == "low", maps["low"]).when(tier == "medium", maps["medium"]).otherwise(maps["high"])


def low_end(low_ram: Column, memory_class: Column) -> Column:
    """Declared short of memory, or of the low tier."""
    return F.coalesce(low_ram, F.lit(False)) | F.coalesce(memory_class <= 128, F.lit(False))


def text_zoom(density: Column) -> Column:
    """Percent by display density."""
    return F.when(density >= 2.0, 100).when(density >= 1.5, 110).when(density >= 1.0, 120).otherwise(130)


def picker_type(name: Column) -> Column:
    """DIRECTORY, FILE or SNAPSHOT_SOURCE by a name or alias; DIRECTORY otherwise."""
    key = F.lower(name)
    return F.when(key == "file", "FILE").when(key.isin("snapshot_source", "snapshot"), "SNAPSHOT_SOURCE").otherwise("DIRECTORY")


def log_level(level: Column) -> Column:
    """debug, info, warn or error by a name or its letter; debug otherwise."""
    key = F.lower(level)
    return F.when(key.isin("info", "i"), "info").when(key.isin("warn", "w"), "warn").when(key.isin("error", "e"), "error").otherwise("debug")


def retry_delay_ms(attempt: Column) -> Column:
    """Wait before the next attempt: short at first."""
    return F.when(attempt < 10, 300).when(attempt < 20, 500).otherwise(1000)


# The standard classes of input and output exceptions, without their packages.
IO_ERRORS = (
    "IOException", "FileNotFoundException", "EOFException", "InterruptedIOException", "UTFDataFormatException", "UnsupportedEncodingException", "CharConversionException", "SyncFailedException",
    "ObjectStreamException", "InvalidClassException", "NotSerializableException", "StreamCorruptedException", "SocketException", "SocketTimeoutException", "ConnectException",
    "BindException", "NoRouteToHostException", "PortUnreachableException", "UnknownHostException", "UnknownServiceException", "ProtocolException", "MalformedURLException", "HttpRetryException",
    "SSLException", "SSLHandshakeException", "SSLKeyException", "SSLPeerUnverifiedException", "SSLProtocolException", "ZipException", "JarException", "FileSystemException", "AccessDeniedException",
    "NoSuchFileException", "FileAlreadyExistsException", "DirectoryNotEmptyException", "NotDirectoryException", "AtomicMoveNotSupportedException", "FileSystemLoopException", "ClosedChannelException",
    "AsynchronousCloseException", "ClosedByInterruptException", "CharacterCodingException", "MalformedInputException", "UnmappableCharacterException",
)


def recovery_action(exception: Column, message: Column, io_errors: Sequence[str] = IO_ERRORS) -> Column:
    """clear_cache, free_memory, ask_permission or none, by an exception's class, then by its message.

    Class names alone don't tell their ancestors, so the input and output exceptions are listed; others can be added.
    """
    name = F.substring_index(exception, ".", -1)
    return (F.when(name.isin(list(io_errors)), "clear_cache").when(name == "OutOfMemoryError", "free_memory")
            .when(contains_any(message, ["permission"]), "ask_permission").otherwise("none"))


def start_failure(error: Column) -> Column:
    """struct(title, message, button) of a failed start: a wrong password, another error, or none told.

    Titles and buttons are fixed values; the messages' sentences are our own.
    """
    wrong = contains_any(error, ["password"])
    title = F.when(error.isNull(), "Server Start Failed").when(wrong, "Incorrect Password").otherwise("Server Error")
    text = (F.when(error.isNull(), "Could not reach the server. Change the repository?").when(wrong, "The repository password is incorrect. Try again?")
            .otherwise(F.concat(error, F.lit("\n\nChange the repository?"))))
    return F.struct(title.alias("title"), text.alias("message"), F.when(wrong, "Retry").otherwise("Change Repository").alias("button"))


def connect_failure(output: Column) -> Column:
    """wrong_password, or other (then a new repository is tried)."""
    return F.when(contains_any(output, ["invalid repository password"]), "wrong_password").otherwise("other")


def password_problem(password: Column, confirmation: Column, existing: Column) -> Column:
    """The first broken rule, null if none: required; then for a new repository too_short (below 8), mismatch."""
    return (F.when(F.coalesce(password, F.lit("")) == "", "required").when(existing, F.lit(None).cast("string"))
            .when(F.length(password) < 8, "too_short").when(~password.eqNullSafe(confirmation), "mismatch"))


# Words that tell an input field for a path.
PATH_WORDS = ("path", "directory", "folder", "location", "repository", "snapshot", "config", "file", "source", "destination", "target")


def path_input(value: Column, *context: Column) -> Column:
    """Whether a field takes a path: a path word in its texts (the parent's cut to 100 characters by the caller), or a slash in its value."""
    return contains_any(F.concat(*[F.coalesce(c, F.lit("")) for c in context]), PATH_WORDS) | contains_any(value, ["/", "\\"], False)


def can_access(path: Column, own_dirs: Column, full_access: Column, found: Column) -> Column:
    """Own folders always, others with full access if they are there.

    Paths below a folder count, its mere namesakes do not (`/a/files2` is not in `/a/files`): a plain prefix test
    would let them in.
    """
    own = F.exists(own_dirs, lambda d: (path == d) | path.startswith(F.concat(F.rtrim(d, F.lit("/")), F.lit("/"))))
    return F.coalesce(own, F.lit(False)) | F.coalesce(full_access & found, F.lit(False))


def access_text(full_access: Column, api_level: Column) -> Column:
    """What to tell of file access, by grant and platform version; the sentences are our own."""
    return (F.when(full_access, "Full filesystem access granted.").when(api_level >= 30, "Limited access. Grant all-files access to reach other folders.")
            .otherwise("Storage permissions required."))


def is_active(state: Column) -> Column:
    """Whether a job waits or runs."""
    return F.coalesce(state.isin("ENQUEUED", "RUNNING"), F.lit(False))


# Who serves documents, downloads and media, and the device's own storage.
EXTERNAL, DOWNLOADS, MEDIA = ("com.android.externalstorage.documents", "com.android.providers.downloads.documents", "com.android.providers.media.documents")
STORAGE = "/storage/emulated/0/"


def authority(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def _decoded(x: Column) -> Column:
    return F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))


def locator_kind(uri: Column) -> Column:
    """tree, document_external, document_download, document_media, file, content, or other; the first that fits."""
    scheme, who = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), authority(uri)
    document = uri.rlike(r"^content://[^/]+/(tree/[^/]+/)?document/[^/]")
    return (F.when(uri.contains("/tree/") & (who == EXTERNAL), "tree").when(document & (who == EXTERNAL), "document_external")
            .when(document & (who == DOWNLOADS), "document_download").when(document & (who == MEDIA), "document_media")
            .when(document, "other").when(scheme == "file", "file").when(scheme == "content", "content").otherwise("other"))


def locator_path(uri: Column) -> Column:
    """The path a locator names where its text tells it; media and content locators need a lookup and give null."""
    kind = locator_kind(uri)
    tree_id = _decoded(F.regexp_extract(uri, r"/tree/([^/?#]+)", 1))
    doc_id = _decoded(F.regexp_extract(uri, r"/document/([^/?#]+)", 1))

    def primary(x: Column) -> Column:
        parts = F.split(x, ":")
        return F.when((F.lower(parts[0]) == "primary") & (F.size(parts) > 1), F.concat(F.lit(STORAGE), parts[1]))

    return (F.when(kind == "tree", primary(tree_id)).when(kind == "document_external", primary(doc_id))
            .when((kind == "document_download") & doc_id.startswith("raw:"), F.substring(doc_id, 5, 1 << 30))
            .when(kind == "file", _decoded(F.regexp_extract(uri, r"^[A-Za-z]+://[^/]*([^?#]*)", 1))))


def media_key(uri: Column) -> Column:
    """struct(collection, id) of a media document, for the lookup; null otherwise."""
    parts = F.split(_decoded(F.regexp_extract(uri, r"/document/([^/?#]+)", 1)), ":")
    known = (locator_kind(uri) == "document_media") & parts[0].isin("image", "video", "audio") & (F.size(parts) > 1)
    return F.when(known, F.struct(parts[0].alias("collection"), F.get(parts, F.lit(1)).alias("id")))


def error_text(body: Column) -> Column:
    """The `error` field of a JSON reply, else the reply itself."""
    return F.coalesce(F.get_json_object(body, "$.error"), body, F.lit("Unknown error"))


def connect_body(path: Column, password: Column) -> Column:
    """The JSON a connect request carries."""
    storage = F.struct(F.lit("filesystem").alias("type"), F.struct(path.alias("path")).alias("config"))
    return F.to_json(F.struct(storage.alias("storage"), password.alias("password")))


def elf_ok(content: Column, length: Column) -> Column:
    """Whether a file's first 64 bytes are the header of a 64-bit ARM position-independent executable."""
    digits = F.hex(F.substring(content, 1, 64))
    byte = lambda i: F.substring(digits, 2 * i + 1, 2)
    little = byte(5) == "01"
    u16 = lambda i: F.when(little, F.concat(byte(i + 1), byte(i))).otherwise(F.concat(byte(i), byte(i + 1)))
    ok = (F.left(digits, F.lit(8)) == "7F454C46") & (byte(4) == "02") & (u16(16) == "0003") & (u16(18) == "00B7")
    return F.coalesce((length >= 0x38) & (F.length(digits) == 128) & ok, F.lit(False))
