"""Package registries read from their checkouts.

A checkout is read as a table (path, text).  Files of one package are brought
together by a key taken from the path and parsed as one row of an Arrow batch, so
a registry of any size is parsed in parallel and a package is never split.  All
registries give the same record.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions.prose import prose
from catalith.sources.grammars import cmake_commands, dependency_names, first_call, ini, manifests, method_calls, module_file, recipe_class

RECORD = (
    "id string, registry string, name string, summary string, description string, licenses array<string>, homepage string, repository_url string, "
    "maintainers array<string>, topics array<string>, dependencies array<string>, options array<string>, default_options map<string,string>, "
    "default_version string, lifecycle string, recipe string, versions array<struct<version:string,revision:string,channel:string,lifecycle:string,"
    "dependencies:array<string>,artifacts:array<struct<kind:string,url:string,filename:string,checksums:array<string>>>>>"
)
# Hosts whose first two path parts name a repository, and those of the CMake fetch functions.
FORGES = {"github.com", "gitlab.com", "bitbucket.org", "codeberg.org"}
FETCHERS = {"vcpkg_from_github": "github.com", "vcpkg_from_gitlab": "gitlab.com", "vcpkg_from_bitbucket": "bitbucket.org", "vcpkg_from_git": "", "vcpkg_from_sourceforge": "", "vcpkg_download_distfile": ""}
# Digest algorithms in listing order; spellings of versions; name prefixes of other languages' packages; channels in order.
DIGESTS = ("md5", "sha1", "sha256", "sha512")
VERSION_KEYS = ("version", "version-semver", "version-date", "version-string")
OTHER_LANGUAGES = ("py-", "perl-", "ruby-", "r-")
OTHER_BUILDS = {"py-setuptools"}
CHANNELS = ("stable", "testing", "beta", "alpha", "legacy")

Files = dict[str, str]


def _strings(value: Any) -> list[str]:
    return [value] if isinstance(value, str) else [v for v in value if isinstance(v, str)] if isinstance(value, (list, tuple)) else []


def _clean(values: Any) -> list[str]:
    return list(dict.fromkeys(s for v in values if (s := str(v).strip())))


def _repository(*urls: Any) -> str:
    for url in urls:
        m = re.match(r"\s*[a-z+]+://(?:www\.)?([^/]+)/+([^/?#]+)/+([^/?#]+)", str(url or "").lower())
        if m and m[1] in FORGES:
            return f"https://{m[1]}/{m[2]}/{m[3].removesuffix('.git')}"
    return ""


def _checksums(values: dict) -> list[str]:
    return [f"{a}:{values[a].lower()}" for a in DIGESTS if isinstance(values.get(a), str) and values[a]]


def _artifact(kind: str, url: str | None, checksums: list[str] | None = None, filename: str | None = None) -> dict:
    return {"kind": kind, "url": url or None, "filename": filename or None, "checksums": checksums or None}


def _option(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, (str, int, float)) else json.dumps(value, sort_keys=True)


def _record(registry: str, name: str, **fields: Any) -> dict:
    text = prose(fields.pop("prose", ""))
    row = {"id": f"{registry}:{name}", "registry": registry, "name": name, "summary": text.summary_text or None, "description": text.body_html or None}
    return row | {k: v if v not in ("", [], {}) else None for k, v in fields.items()}


def _named(values: Any) -> list[str]:
    return _clean(v if isinstance(v, str) else v.get("name", "") for v in values or [] if isinstance(v, (str, dict)))


def vcpkg(key: str, files: Files) -> list[dict]:
    """One port: manifest, port file and version history."""
    manifest = json.loads(next(t for p, t in files.items() if p.endswith("/vcpkg.json")))
    port = next((t for p, t in files.items() if p.endswith("/portfile.cmake")), "")
    history = next((json.loads(t) for p, t in files.items() if p.startswith("versions/")), {})
    spelled = lambda d: next((str(d[k]) for k in VERSION_KEYS if k in d), "")
    current, homepage = spelled(manifest), str(manifest.get("homepage") or "")
    function, body = first_call(port, set(FETCHERS))
    urls = _clean(re.findall(r"https?://[^\s\")]+", body))
    sums = [f"{a.lower()}:{d.lower()}" for a, d in re.findall(r"\b(MD5|SHA1|SHA256|SHA512)\s+([0-9a-fA-F]+)", body)]
    repository, repo, ref = "", re.search(r"\bREPO\s+\"?([\w.-]+/[\w.-]+)", body), re.search(r"\bREF\s+(?:\"([^\"]+)\"|([^\s\")]+))", body)
    if repo and FETCHERS.get(function):
        repository = f"https://{FETCHERS[function]}/{repo[1]}"
        if ref and function == "vcpkg_from_github":
            urls.append(f"{repository}/archive/{ref[1] or ref[2]}.tar.gz")
    versions = [{"version": v, "revision": str(i.get("port-version") or "") or None} for i in history.get("versions", []) if (v := spelled(i))]
    versions = versions or ([{"version": current}] if current else [])
    features = manifest.get("features") or {}
    wanted = _named(manifest.get("dependencies")) + [d for f in features.values() for d in _named(f.get("dependencies"))]
    for v in versions:
        if v["version"] == current:
            v["artifacts"] = [_artifact("upstream_source", u, sums) for u in urls] or ([_artifact("upstream_source", None, sums)] if sums else None)
            v["dependencies"] = _clean(wanted) or None
    name = str(manifest.get("name") or key)
    return [_record(
        "vcpkg", name, prose=" ".join(_strings(manifest.get("description"))), licenses=_clean(_strings(manifest.get("license"))), homepage=homepage,
        repository_url=repository or _repository(homepage, *urls), dependencies=_clean(wanted), options=sorted(features),
        default_options={n: "enabled" for n in _named(manifest.get("default-features") if isinstance(manifest.get("default-features"), list) else [])}, versions=versions)]


def conan(key: str, files: Files) -> list[dict]:
    """One recipe: version folders, recipe classes and their data."""
    import yaml

    config = yaml.safe_load(next(t for p, t in files.items() if p.endswith("/config.yml"))) or {}
    folders: dict[str, list[str]] = {}
    for version, value in (config.get("versions") or {}).items():
        if isinstance(value, dict) and value.get("folder"):
            folders.setdefault(str(value["folder"]), []).append(str(version))
    first, versions, wanted, options, defaults = None, [], [], set(), {}
    for folder, listed in folders.items():
        base = f"recipes/{key}/{folder}/"
        source = files.get(base + "conanfile.py", "")
        recipe = recipe_class(source)
        first = first or (recipe if recipe.attributes else None)
        needs = _clean(r.split("/", 1)[0] for r in _strings(recipe.attributes.get("requires")) + method_calls(source, {"requires", "tool_requires", "test_requires"}))
        wanted += needs
        options |= set(recipe.attributes.get("options") or {})
        defaults |= {k: _option(v) for k, v in (recipe.attributes.get("default_options") or {}).items()}
        sources = (yaml.safe_load(files.get(base + "conandata.yml", "")) or {}).get("sources") or {}
        for version in listed:
            held = sources.get(version) or {}
            items = [i for i in held if isinstance(i, dict)] if isinstance(held, list) else [held]
            made = [_artifact("upstream_source", u, _checksums(i)) for i in items for u in _strings(i.get("url"))]
            versions.append({"version": version, "dependencies": needs or None, "artifacts": made or None})
    said = (first or recipe_class("")).attributes
    urls = [a["url"] for v in versions for a in v["artifacts"] or []]
    return [_record(
        "conan", str(said.get("name") or key), prose=str(said.get("description") or ""), licenses=_clean(_strings(said.get("license"))), homepage=str(said.get("homepage") or ""),
        repository_url=_repository(said.get("homepage"), *urls), maintainers=_strings(said.get("author")), topics=_strings(said.get("topics")), dependencies=_clean(wanted),
        options=sorted(options), default_options=defaults, lifecycle="deprecated" if said.get("deprecated") else None, versions=versions)]


def spack(key: str, files: Files) -> list[dict]:
    """One recipe class; packages of other languages are left out."""
    recipe = recipe_class(next(iter(files.values())))
    name = key.removeprefix("_").replace("_", "-")
    calls = lambda n: [(a, k) for a, k in recipe.calls.get(n, []) if a and a[0] is not None]
    wanted = [re.split(r"[@+~ ]", str(a[0]))[0] for a, _ in calls("depends_on")]
    if name.startswith(OTHER_LANGUAGES) or OTHER_BUILDS & set(wanted):
        return []
    said = recipe.attributes
    versions = [{"version": str(a[0]), "lifecycle": "deprecated" if k.get("deprecated") else None, "artifacts": [_artifact("upstream_source", None, _checksums(k))] if _checksums(k) else None} for a, k in calls("version")]
    return [_record(
        "spack", name, prose=recipe.doc or str(said.get("description") or ""), licenses=_clean(a[0] for a, _ in calls("license")), homepage=str(said.get("homepage") or ""),
        repository_url=_repository(said.get("git"), said.get("homepage"), said.get("url")), maintainers=_clean(m for a, _ in calls("maintainers") for m in a),
        topics=_strings(said.get("tags")), dependencies=_clean(wanted), options=_clean(a[0] for a, _ in calls("variant")),
        default_options={str(a[0]): _option(k["default"]) for a, k in calls("variant") if k.get("default") is not None}, versions=versions)]


def meson(key: str, files: Files) -> list[dict]:
    """One wrap file and its entry of the release list."""
    sections = ini(next(t for p, t in files.items() if p.endswith(".wrap")))
    wrap, provide = sections.get("wrap-file", {}), sections.get("provide", {})
    release = json.loads(files.get("releases.json") or "{}").get(key, {})
    directory = wrap.get("directory", "")
    current = directory.removeprefix(f"{key}-") if directory.startswith(f"{key}-") else ""
    source = _artifact("upstream_source", wrap.get("source_url"), [f"sha256:{wrap['source_hash'].lower()}"] if wrap.get("source_hash") else None, wrap.get("source_filename"))
    parts = [_clean(release.get(n) or provide.get(n, "").replace(",", " ").split()) for n in ("dependency_names", "program_names")]
    versions = []
    for listed in map(str, release.get("versions", [])):
        upstream, revision = listed.rsplit("-", 1) if "-" in listed else (listed, None)
        artifacts = [_artifact("registry_package", f"https://wrapdb.mesonbuild.com/v2/{key}_{listed}/{key}.wrap")]
        versions.append({"version": upstream, "revision": revision, "artifacts": artifacts + ([source] if upstream == current and source["url"] else [])})
    if not versions and current:
        versions = [{"version": current, "artifacts": [source]}]
    return [_record("meson", key, repository_url=_repository(wrap.get("source_url")), options=parts[0] + parts[1], versions=versions)]


def bazel(key: str, files: Files) -> list[dict]:
    """One module: metadata, and source and module file of every version."""
    base = f"modules/{key}/"
    data = json.loads(files[base + "metadata.json"])
    versions, wanted = [], []
    for listed in map(str, data.get("versions", [])):
        if f"{base}{listed}/source.json" not in files:
            continue
        source = json.loads(files[f"{base}{listed}/source.json"])
        needs, _ = module_file(files.get(f"{base}{listed}/MODULE.bazel", ""))
        public = [d["name"] for d in needs if d["kind"] != "dev"]
        wanted = public if needs else wanted
        m = re.fullmatch(r"([a-z0-9]+)-([A-Za-z0-9+/=]+)", source.get("integrity") or "")
        sums = [f"{m[1]}:{base64.b64decode(m[2]).hex()}"] if m else None
        upstream, _, revision = listed.partition(".bcr.")
        versions.append({
            "version": upstream, "revision": revision or None, "lifecycle": "yanked" if (data.get("yanked_versions") or {}).get(listed) else None,
            "dependencies": public or None, "artifacts": [_artifact("upstream_source", u, sums) for u in _clean([source.get("url", ""), *source.get("mirror_urls", [])])]})
    people = [f"{p['name']} (@{p['github']})" if p.get("name") and p.get("github") else p.get("name") or (p.get("github") and f"@{p['github']}") or p.get("email", "") if isinstance(p, dict) else str(p) for p in data.get("maintainers", [])]
    repos = [re.sub(r"^github:", "https://github.com/", r) for r in _strings(data.get("repository"))]
    return [_record("bazel", key, homepage=str(data.get("homepage") or ""), repository_url=_repository(*repos), maintainers=_clean(people), dependencies=wanted, lifecycle="deprecated" if data.get("deprecated") else None, versions=versions)]


def cppget(key: str, files: Files) -> list[dict]:
    """All channels' manifests; packages are merged by name in channel order."""
    rows: dict[str, dict] = {}
    for channel in CHANNELS:
        for m in manifests(files.get(f"{channel}/packages.manifest", "")):
            one = lambda k, m=m: (m.get(k) or [""])[0]
            name, version = one("name"), one("version")
            if not name or not version:
                continue
            wanted = dependency_names(m.get("depends", []))
            new = _record("cppget", name, prose=one("description") or one("summary"), licenses=_clean(m.get("license", [])), homepage=one("url"), repository_url=_repository(one("src-url") or one("url")), topics=_clean(m.get("topics", []) + m.get("keywords", [])), versions=[])
            new["summary"] = prose(one("summary")).summary_text or None
            row = rows.setdefault(name, new | {"versions": []})
            for k in ("repository_url", "description", "homepage", "licenses"):
                row[k] = row[k] or new[k]
            row["dependencies"] = wanted or row.get("dependencies")
            url = f"https://pkg.cppget.org/1/{channel}/{one('location')}" if one("location") else None
            made = _artifact("registry_package", url, [f"sha256:{one('sha256sum').lower()}"] if one("sha256sum") else None)
            same = next((v for v in row["versions"] if (v["version"], v["channel"]) == (version, channel)), None)
            if same is None:
                same = {"version": version, "channel": channel, "dependencies": wanted or None, "artifacts": []}
                row["versions"].append(same)
            if made["url"] or made["checksums"]:
                same["artifacts"].append(made)
    return list(rows.values())


def hunter(key: str, files: Files) -> list[dict]:
    """One project file and the default versions."""
    defaults = {a[0]: a[2] for c, a in cmake_commands(files.get("cmake/configs/default.cmake", "")) if c.lower() == "hunter_default_version" and len(a) >= 3 and a[1].lower() == "version"}
    found = []
    for command, a in cmake_commands(next(t for p, t in files.items() if p.endswith("/hunter.cmake"))):
        if command.lower() == "hunter_add_version":
            said = dict(zip(a[::2], a[1::2], strict=True))
            if missing := {"PACKAGE_NAME", "VERSION", "URL", "SHA1"} - set(said):
                raise ValueError(f"{key}: a version lacks {sorted(missing)}")
            found.append(said)
    if not found:
        return []
    if len({f["PACKAGE_NAME"] for f in found}) > 1:
        raise ValueError(f"{key}: versions of several packages")
    name = found[0]["PACKAGE_NAME"]
    versions = [{"version": f["VERSION"], "artifacts": [_artifact("upstream_source", f["URL"], [f"sha1:{f['SHA1'].lower()}"])]} for f in found]
    return [_record("hunter", name, repository_url=_repository(*[f["URL"] for f in found]), default_version=defaults.get(name), versions=versions)]


def xmake(key: str, files: Files) -> list[dict]:
    """The exporter's JSON: all packages of the registry."""
    data = json.loads(next(iter(files.values())))
    if not data.get("packages") and data.get("skipped"):
        raise ValueError("the exporter loaded no package")
    out = []
    for p in data.get("packages", []):
        clean = lambda v: [re.sub(r"^git\+", "", u) for u in _clean(v or [])]
        versions = [{"version": v["version"], "artifacts": [_artifact("upstream_source", u, _clean(v.get("checksums", [])) if len(v.get("source_urls", [])) == 1 else None) for u in clean(v.get("source_urls"))] or None} for v in p.get("versions", [])]
        out.append(_record(
            "xmake", p["name"], prose=str(p.get("description") or ""), licenses=_clean(p.get("licenses", [])), homepage=str(p.get("homepage") or ""),
            repository_url=_repository(*clean(p.get("urls")), *[u for v in p.get("versions", []) for u in clean(v.get("source_urls"))], p.get("homepage")),
            dependencies=_clean(p.get("dependencies", [])), options=sorted(p.get("configs") or {}), versions=versions, recipe=p.get("recipe")))
    return out


#: Parser of each registry, pattern of its files, how a path gives the package (group 1 that matches), and files all packages share.
REGISTRIES: dict[str, tuple[Callable[[str, Files], list[dict]], str, list[str]]] = {
    "vcpkg": (vcpkg, r"^ports/([^/]+)/(?:vcpkg\.json|portfile\.cmake)$|^versions/[^/]+/([^/]+)\.json$", []),
    "conan": (conan, r"^recipes/([^/]+)/(?:config\.yml|[^/]+/(?:conanfile\.py|conandata\.yml))$", []),
    "spack": (spack, r"^(?:repos/spack_repo/builtin/)?packages/([^/]+)/package\.py$", []),
    "meson": (meson, r"^subprojects/([^/]+)\.wrap$", ["releases.json"]),
    "bazel": (bazel, r"^modules/([^/]+)/(?:metadata\.json|[^/]+/(?:source\.json|MODULE\.bazel))$", []),
    "cppget": (cppget, r"^([a-z]+)/packages\.manifest$", []),
    "hunter": (hunter, r"^cmake/projects/([^/]+)/hunter\.cmake$", ["cmake/configs/default.cmake"]),
    "xmake": (xmake, r"^([^/]+)\.json$", []),
}
#: The file without which a key is no package.
NEEDED = {"vcpkg": "/vcpkg.json", "conan": "/config.yml", "meson": ".wrap", "bazel": "/metadata.json", "hunter": "/hunter.cmake"}


def checkout(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of all files of a checkout, paths relative to its root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", r"^(?:file:)?/*" + re.escape(root.strip("/")) + "/*", "")
    return files.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"))


#: Characters that the files which all records of a registry need may have together.
SHARED_CHARS = 64_000_000


def _shared_texts(files: DataFrame) -> dict[str, str]:
    """The few files that every record needs, on the driver; refused beyond SHARED_CHARS."""
    if (files.agg(F.sum(F.length("text"))).first()[0] or 0) > SHARED_CHARS:
        raise ValueError(f"shared files of more than {SHARED_CHARS} characters")
    return {r["path"]: r["text"] for r in files.collect()}


def parse(files: DataFrame, registry: str) -> DataFrame:
    """Records of a registry from its files (path, text)."""
    if registry not in REGISTRIES:
        raise ValueError(f"unknown registry: {registry}")
    parser, pattern, shared = REGISTRIES[registry]
    groups = pattern.count("(") - pattern.count("(?:")
    key = F.coalesce(*[F.nullif(F.regexp_extract("path", pattern, i + 1), F.lit("")) for i in range(groups)])
    own = files.where(F.col("path").rlike(pattern)).withColumn("key", F.lit("all") if registry == "cppget" else key)
    common = _shared_texts(files.where(F.col("path").isin(shared))) if shared else {}
    needed = NEEDED.get(registry, "")

    columns = [c.strip().split(" ")[0] for c in re.split(r",\s(?=\w+ )", RECORD)]
    parts = ("version", "revision", "channel", "lifecycle", "dependencies", "artifacts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, held in zip(pdf["key"], pdf["files"], strict=True):
                mine = {f["path"]: f["text"] for f in held}
                if any(p.endswith(needed) for p in mine):
                    rows += parser(k, common | mine)
            whole = [{c: r.get(c) for c in columns} for r in rows]
            for r in whole:
                r["versions"] = [{k: v.get(k) for k in parts} for v in r["versions"] or []]
            yield pd.DataFrame(whole, columns=columns)

    return own.groupBy("key").agg(F.collect_list(F.struct("path", "text")).alias("files")).mapInPandas(run, RECORD)


def parse_named(files: DataFrame, registry: str, name: str) -> DataFrame:
    """Records of one package only; none is an error."""
    found = parse(files.where(F.col("path").contains(f"/{name}/") | F.col("path").isin(REGISTRIES[registry][2] or [])), registry).where(F.col("name") == name)
    if found.isEmpty():
        raise ValueError(f"no package {name} in {registry}")
    return found
