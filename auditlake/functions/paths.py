"""Paths, file kinds, routes and addresses as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories, names and files that a scan leaves out.
EXCLUDED_DIRS = [
    "vendor", "node_modules", "third_party", "thirdparty", "external", "site-packages", "bower_components",
    ".git", ".cache", ".next", "dist", "build", "__pycache__", ".venv", "venv", "env", "graphify-out", ".idea", ".vscode",
    ".gradle", "target", "tests", "__tests__", "spec", "specs", "docs", ".github", ".gitlab",
]
EXCLUDED_DIR_GLOBS = ["report_[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]_[0-9][0-9][0-9][0-9][0-9][0-9]"]
EXCLUDED_NAME_GLOBS = ["*.md", "*.markdown", "*.txt", "*.rst", "*.adoc", "*.rdoc", "*.test.*", "*.spec.*", "test_*", "*_test.*", "*_spec.*"]
MANIFEST_NAMES = [
    "requirements.txt", "requirements.in", "Pipfile", "Pipfile.lock", "poetry.lock", "pyproject.toml", "environment.yml",
    "conda.yaml", "conda-lock.yml", "package.json", "packages.json", "package-lock.json", "npm-shrinkwrap.json", "yarn.lock",
    "pnpm-lock.yaml", "bun.lock", "bun.lockb", "deno.lock", "deno.json", "deno.jsonc", "pom.xml", "build.gradle",
    "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "gradle.lockfile", "gradle/libs.versions.toml", "ivy.xml",
    "go.mod", "go.sum", "Gemfile", "Gemfile.lock", "gems.rb", "gems.locked", "composer.json", "composer.lock", "Cargo.toml",
    "Cargo.lock", "pubspec.yaml", "pubspec.lock", "mix.exs", "mix.lock", "Package.swift", "Package.resolved", "Podfile",
    "Podfile.lock", "packages.config", "packages.lock.json", "project.json", "project.lock.json", "global.json", "vcpkg.json",
    "conanfile.txt", "conanfile.py", "conan.lock", "CMakeLists.txt",
]
# End of the fixed values.


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression over the whole text; '*' crosses slashes, brackets are classes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def exclusion_regex(patterns: list[str] | None = None, defaults: bool = True) -> str:
    """One expression for all rules. A bare token names a directory at any depth, others are globs over the path; a
    closing slash means all below. With no rule at all it matches nothing."""
    dirs, globs = list(EXCLUDED_DIRS) if defaults else [], []
    for p in (x.strip() for x in patterns or []):
        if p and "/" not in p and "*" not in p:
            dirs.append(p)
        elif p:
            globs.append(p + "**" if p.endswith("/") else p)
    parts = [rf"(?:^|/)(?:{'|'.join(map(re.escape, dirs))})(?:/|$)"] if dirs else []
    if defaults:
        parts.append(rf"(?:^|/)(?:{'|'.join(map(glob_regex, EXCLUDED_DIR_GLOBS))})(?:/|$)")
        parts.append(rf"(?:^|/)(?:{'|'.join(glob_regex(g).replace('.*', '[^/]*') for g in EXCLUDED_NAME_GLOBS)})$")
    parts += [rf"^(?:{glob_regex(g)})$" for g in globs]
    return "|".join(parts) or "(?!)"


def is_excluded(path: Column | str, patterns: list[str] | None = None, defaults: bool = True) -> Column:
    """Whether a scan leaves a path out; null and empty paths stay."""
    c = F.col(path) if isinstance(path, str) else path
    return F.coalesce(c.rlike(exclusion_regex(patterns, defaults)) & (c != ""), F.lit(False))


def base_name(path: Column | str) -> Column:
    return F.substring_index(F.rtrim(F.col(path) if isinstance(path, str) else path, F.lit("/")), "/", -1)


def is_manifest(path: Column | str) -> Column:
    """Whether a path names a dependency manifest or lock file; null and empty ones don't."""
    return F.coalesce(base_name(path).isin(MANIFEST_NAMES), F.lit(False))


def directory(path: Column | str) -> Column:
    """The directories of a path, '_root' without any."""
    parts = F.filter(F.split(F.coalesce(F.col(path) if isinstance(path, str) else path, F.lit("")), "/"), lambda x: x != "")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(F.size(dirs) > 0, F.array_join(dirs, "/")).otherwise(F.lit("_root"))


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))


# What stands for a segment in a route, and how an address names a path.
ROUTE_PARAMETER = r"<[^>]+>|\{[^}]*\}|:[A-Za-z_][A-Za-z0-9_]*"
ADDRESS_PATH = r"(?i)^[a-z][a-z0-9+.\-]*://[^/]+(/.*)$"
# End of the fixed values.


def route_regex(route: Column) -> Column:
    """A route as an expression: parameters match one segment, '*' anything, the rest itself."""
    parts = F.regexp_extract_all(route, F.lit(rf"({ROUTE_PARAMETER}|\*|[^<{{:*]+|.)"), 1)
    one = lambda p: F.when(p == "*", F.lit(".*")).when(p.rlike(f"^(?:{ROUTE_PARAMETER})$"), F.lit("[^/]+")).otherwise(F.concat(F.lit(r"\Q"), p, F.lit(r"\E")))
    return F.array_join(F.transform(parts, one), "")


def request_path(address: Column) -> Column:
    """The path of an address or path without query and closing slash; null for what is neither."""
    path = F.when(address.startswith("/"), address).otherwise(F.nullif(F.regexp_extract(address, ADDRESS_PATH, 1), F.lit("")))
    bare = F.rtrim(F.substring_index(path, "?", 1), F.lit("/"))
    return F.when(bare == "", F.lit("/")).otherwise(bare)


def has_parameter(route: Column) -> Column:
    return route.rlike(r"[:{*<]")


def origin(address: Column) -> Column:
    """scheme://host:port in lower case with the default port filled in; null for addresses with user information,
    control characters, another scheme than http(s), or no host."""
    a = trim_slashes(address)
    scheme = F.lower(F.regexp_extract(a, r"(?i)^(https?)://", 1))
    authority = F.regexp_extract(a, r"(?i)^https?://([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(authority, r"^(\[[^\]]+\]|[^:]*)(?::(\d*))?$", 1))
    port = F.regexp_extract(authority, r"^(\[[^\]]+\]|[^:]*)(?::(\d*))?$", 2)
    filled = F.when(port != "", port).when(scheme == "https", "443").otherwise("80")
    bad = address.rlike(r"[\x00-\x20\x7f\\]") | F.contains(authority, F.lit("@")) | (host == "") | (scheme == "")
    return F.when(~bad, F.concat(scheme, F.lit("://"), host, F.lit(":"), filled))


def trim_slashes(address: Column) -> Column:
    return F.rtrim(address, F.lit("/"))


# Files of a container worth keeping, what is never one, and where entry points are declared.
ARTIFACT_PATTERNS = [
    r"(^|/)nginx[^/]*\.conf$", r"(^|/)nginx/conf\.d/.*\.conf$", r"(^|/)httpd[^/]*\.conf$", r"(^|/)apache2/.*\.conf$",
    r"(^|/)\.htaccess$", r"(^|/)Caddyfile$", r"(^|/)haproxy\.cfg$", r"(^|/)lighttpd\.conf$", r"(^|/)traefik\.(yml|yaml|toml)$",
    r"(^|/)envoy\.ya?ml$", r"(^|/)supervisord[^/]*\.conf$", r"(^|/)gunicorn[^/]*\.(conf|py)$", r"(^|/)uwsgi[^/]*\.(ini|ya?ml|yml|json)$",
    r"(^|/)php(-fpm)?[^/]*\.(ini|conf)$", r"(^|/)my\.cnf$", r"(^|/)redis\.conf$", r"(^|/)mongod\.conf$", r"(^|/)docker-entrypoint[^/]*$",
    r"(^|/)entrypoint[^/]*\.sh$", r"(^|/)docker-entrypoint\.d/.*", r"(^|/)start\.sh$", r"(^|/)\.env($|\.)", r"(^|/)\.next/[^/]*\.json$",
    r"(^|/)package\.json$", r"(^|/)composer\.json$", r"(^|/)Gemfile$", r"(^|/)requirements[^/]*\.txt$",
    r"(^|/)etc/[^/]*\.(conf|ini|cfg|ya?ml|yml|toml|json)$",
]
ARTIFACT_EXCLUDED_DIRS = ["node_modules", "vendor", ".git"]
BINARY_EXTENSIONS = [
    ".so", ".o", ".a", ".bin", ".class", ".jar", ".woff", ".ttf", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".webp", ".pdf", ".gz",
    ".xz", ".zip", ".whl", ".tgz", ".tar",
]
NOISE_EXTENSIONS = [".map", ".rsc", ".meta", ".html", ".htm", ".css", ".svg", ".nft.json", ".trace"]
NOISE_DIRS = ["/.next/", "/build/", "/server/", "/static/", "/cache/", "/diagnostics/", "/media/"]
SOURCE_EXTENSIONS = [".py", ".js", ".jsx", ".ts", ".tsx", ".php", ".java", ".go", ".rb", ".rs", ".c", ".h", ".cc", ".cpp", ".hpp", ".cs", ".vue"]
CATCH_ALL_BYTES = 256 * 1024
ENTRY_DIRS = [
    "ajax", "front", "api", "apiv1", "grpc", "internal", "controller", "controllers", "route", "routes", "router", "web", "handler",
    "handlers", "worker", "workers", "tasks", "jobs", "consumer", "consumers", "listener", "listeners", "middleware",
]
ENTRY_NAMES = ["routes.php", "web.php", "routing.py", "urls.py", "api.php", "routes.ts", "routes.js", "app.ts", "app.js", "server.ts", "server.js"]
# End of the fixed values.


def artifact_regex() -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in ARTIFACT_PATTERNS)


def in_dirs(path: Column, dirs: list[str]) -> Column:
    return path.rlike(rf"(?:^|/)(?:{'|'.join(map(re.escape, dirs))})/")


def is_artifact(path: Column | str) -> Column:
    """Whether a container's file is one of the known kinds of configuration, outside dependency trees."""
    c = F.col(path) if isinstance(path, str) else path
    return F.coalesce(c.rlike(artifact_regex()) & ~in_dirs(c, ARTIFACT_EXCLUDED_DIRS), F.lit(False))


def is_other_config(path: Column, size: Column, root: str) -> Column:
    """Whether a file may be configuration by its place alone: small, below the working folder, and no source, binary,
    page or build output. A root or empty working folder has none."""
    top = root.strip("/")
    if not top:
        return F.lit(False)
    low = F.lower(path)
    noise = low.rlike("(?:" + "|".join(map(re.escape, NOISE_EXTENSIONS)) + ")$") | F.concat(F.lit("/"), low).rlike("|".join(map(re.escape, NOISE_DIRS)))
    below = F.ltrim(path, F.lit("/")).startswith(top + "/") | (F.ltrim(path, F.lit("/")) == top)
    return F.coalesce(size.between(1, CATCH_ALL_BYTES) & below & ~noise & ~extension(path).isin(SOURCE_EXTENSIONS + BINARY_EXTENSIONS) & ~in_dirs(path, ARTIFACT_EXCLUDED_DIRS), F.lit(False))


def is_entry_file(path: Column | str) -> Column:
    """Whether a file may declare routes or workers, by a directory or its name."""
    c = F.col(path) if isinstance(path, str) else path
    return F.coalesce(F.arrays_overlap(F.split(c, "/"), F.array(*map(F.lit, ENTRY_DIRS))) | base_name(c).isin(ENTRY_NAMES), F.lit(False))
