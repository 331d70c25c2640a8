"""Package manifests: dependencies, scripts, entry points, workspaces and aliases by ecosystem."""

from __future__ import annotations

import json
import posixpath
import re
import tomllib
import xml.etree.ElementTree as ET

from cartograph.sources.facts import Out, get, listing, mapping, text
from cartograph.sources.readers import blocks

# Sections of package.json, Cargo.toml and their scopes; file names that mark requirements as development.
NPM = {"dependencies": "runtime", "devDependencies": "dev", "peerDependencies": "build", "optionalDependencies": "build"}
CARGO = {"dependencies": "runtime", "dev-dependencies": "dev", "build-dependencies": "build"}
DEV_NAMES = r"(?i)(^|[^a-z])(dev|test|tests|lint|docs?|ci)([^a-z]|$)"
DEV_GROUPS = ("development", "test", "lint", "doc", "ci")


def line_of(source: str, needle: str) -> int:
    """The first line that holds ``needle``; 0 if none does."""
    at = source.find(needle)
    return source.count("\n", 0, at) + 1 if at >= 0 else 0


def normal(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name).lower()


def requirement(line: str) -> tuple[str, str, str] | None:
    """(normal name, version, source) of a requirement line; None for an option or blank."""
    egg = re.search(r"#egg=([A-Za-z0-9._-]+)", line)
    body = re.sub(r"(^|\s)#.*$", "", line).split(";")[0].strip()
    if egg and re.match(r"(-e\s+)?[a-z+]+://|git\+", body):
        return normal(egg[1]), "", re.sub(r"#egg=.*$", "", body.removeprefix("-e ").strip())
    m = re.match(r"^([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*(?:@\s*(\S+)|(.*))$", body)
    if not m or body.startswith("-"):
        return None
    return normal(m[1]), (m[3] or "").strip().strip("()"), m[2] or ""


def go_mod(source: str, path: str, out: Out) -> None:
    tool = re.search(r"^toolchain\s+(\S+)", source, re.M) or re.search(r"^go\s+(\S+)", source, re.M)
    if m := re.search(r"^module\s+(\S+)", source, re.M):
        out.add("module", m[1].strip('"'), tool[1].removeprefix("go") if tool else "", ecosystem="go")
    for word, body, single in re.findall(r"^(require|replace|use)\s*(?:\(([^)]*)\)|(\S.*))$", source, re.M):
        for line in (body or single).split("\n"):
            note = line.partition("//")[2]
            parts = line.partition("//")[0].split()
            at = line_of(source, line.strip()) if line.strip() else 0
            if word == "require" and len(parts) >= 2:
                out.dep(parts[0], parts[1], "indirect" if "indirect" in note else "runtime", "go", at)
            elif word == "use" and parts:
                out.add("workspace", posixpath.normpath(parts[0]), ecosystem="go", line=at)
            elif word == "replace" and "=>" in parts:
                k = parts.index("=>")
                to = parts[k + 1] if k + 1 < len(parts) else ""
                if to.startswith((".", "/")):
                    out.add("workspace", posixpath.normpath(to), parts[0], ecosystem="go", line=at)
                elif to:
                    out.dep(to, parts[k + 2] if k + 2 < len(parts) else "", "runtime", "go", at, source=parts[0])


def package_json(source: str, path: str, out: Out) -> None:
    data = json.loads(source)
    if data.get("name"):
        out.add("module", data["name"], data.get("version", ""), ecosystem="npm")
    for section, scope in NPM.items():
        for k, v in mapping(data.get(section)).items():
            registry = isinstance(v, str) and not re.match(r"[a-z+]+:|\.{0,2}/|[\w-]+/[\w.-]+(#|$)", v)
            out.dep(k, v if registry else "", scope, "npm", line_of(source, f'"{k}"'), source="" if registry else v, optional=section == "optionalDependencies")
    for k, v in mapping(data.get("scripts")).items():
        out.add("script", k, v, line=line_of(source, f'"{k}"'))
    binaries = data.get("bin")
    for k, v in ({str(data.get("name", "")).rpartition("/")[2]: binaries} if isinstance(binaries, str) else mapping(binaries)).items():
        out.add("entrypoint", k, v)
    if isinstance(data.get("main"), str):
        out.add("entrypoint", "main", data["main"])
    spaces = data.get("workspaces")
    for w in listing(spaces.get("packages") if isinstance(spaces, dict) else spaces):
        out.add("workspace", w, ecosystem="npm")


def pyproject(source: str, path: str, out: Out) -> None:
    data = tomllib.loads(source)
    project = mapping(data.get("project"))
    tool = mapping(data.get("tool"))
    poetry = mapping(tool.get("poetry"))
    name = project.get("name") or poetry.get("name")
    if name:
        out.add("module", name, project.get("version") or poetry.get("version") or "", ecosystem="pypi", floor=project.get("requires-python") or get(poetry, "dependencies", "python") or "")

    def lines(values, scope: str, **attrs):
        for x in listing(values):
            if isinstance(x, str) and (r := requirement(x)):
                out.dep(r[0], r[1], scope, "pypi", line_of(source, x), source=r[2], **attrs)

    lines(project.get("dependencies"), "runtime")
    lines(get(data, "build-system", "requires"), "build")
    for values in mapping(project.get("optional-dependencies")).values():
        lines(values, "runtime", optional=True)
    for group in (data.get("dependency-groups"), get(tool, "pdm", "dev-dependencies")):
        for values in mapping(group).values():
            lines(values, "dev")
    lines(get(tool, "uv", "dev-dependencies"), "dev")
    sections = [("dependencies", "runtime", poetry), ("dev-dependencies", "dev", poetry), *(("dependencies", "dev", g) for g in mapping(poetry.get("group")).values())]
    for section, scope, table in sections:
        for k, v in mapping(mapping(table).get(section)).items():
            if k != "python":
                out.dep(normal(k), v if isinstance(v, str) else mapping(v).get("version", ""), scope, "pypi", line_of(source, k), source=mapping(v).get("git") or mapping(v).get("url") or mapping(v).get("path") or "", optional=mapping(v).get("optional") is True)
    for kind in ("scripts", "gui-scripts"):
        for k, v in mapping(project.get(kind)).items():
            out.add("entrypoint", k, v)
    for k, v in mapping(poetry.get("scripts")).items():
        out.add("entrypoint", k, v)


def requirements(source: str, path: str, out: Out) -> None:
    scope = "dev" if re.search(DEV_NAMES, path.rpartition("/")[2]) else "runtime"
    for n, line in enumerate(source.split("\n"), 1):
        if line.rstrip().endswith("\\"):
            out.complete = False
        if r := requirement(line):
            out.dep(r[0], r[1].rstrip("\\ "), scope, "pypi", n, source=r[2])


def cargo(source: str, path: str, out: Out) -> None:
    data = tomllib.loads(source)
    if get(data, "package", "name"):
        out.add("module", data["package"]["name"], get(data, "package", "version"), ecosystem="crates.io")
    for w in listing(get(data, "workspace", "members")):
        out.add("workspace", w, ecosystem="crates.io")
    for b in listing(data.get("bin")):
        out.add("entrypoint", mapping(b).get("name"), mapping(b).get("path", ""))
    for t in (data, mapping(data.get("workspace")), *mapping(data.get("target")).values()):
        for section, scope in CARGO.items():
            for k, v in mapping(mapping(t).get(section)).items():
                table = v if isinstance(v, dict) else {"version": v}
                version = "workspace" if table.get("workspace") else table.get("version", "")
                out.dep(table.get("package", k), version, scope, "crates.io", line_of(source, k), source=table.get("git") or "", local="path" in table, at=table.get("path") or "", optional=table.get("optional") is True)


def composer(source: str, path: str, out: Out) -> None:
    data = json.loads(source)
    if data.get("name"):
        out.add("module", data["name"], data.get("version", ""), ecosystem="composer")
    for section, scope in (("require", "runtime"), ("require-dev", "dev")):
        for k, v in mapping(data.get(section)).items():
            if k != "php" and not k.startswith(("ext-", "lib-")):
                out.dep(k, v, scope, "composer", line_of(source, f'"{k}"'))
    for section in ("autoload", "autoload-dev"):
        for kind in ("psr-4", "psr-0"):
            for prefix, dirs in mapping(get(data, section, kind)).items():
                out.add("alias", prefix, scope=kind, ecosystem="composer", items=[d.rstrip("/") for d in listing(dirs)])
    for k, v in mapping(data.get("scripts")).items():
        out.add("script", k, v)
    for b in listing(data.get("bin")):
        out.add("entrypoint", posixpath.basename(b), b)
    repos = data.get("repositories")
    for r in repos.values() if isinstance(repos, dict) else listing(repos):
        if mapping(r).get("type") == "path":
            out.add("workspace", r.get("url"), ecosystem="composer")


def gemfile(source: str, path: str, out: Out) -> None:
    groups: list[bool] = []
    for n, line in enumerate(source.split("\n"), 1):
        if re.match(r"\s*group\b.*\bdo\b", line):
            groups.append(any(re.search(rf"\b{g}\b", line) for g in DEV_GROUPS))
        elif re.match(r"\s*(?!gem\b)\w+.*\bdo\b\s*(\|.*\|)?\s*$", line):
            groups.append(False)
        elif re.match(r"\s*end\b", line) and groups:
            groups.pop()
        elif m := re.match(r"\s*(?:gem|\w+\.add_(?:runtime_|development_)?dependency)\s*\(?\s*['\"]([^'\"]+)['\"](.*)$", line):
            versions = []
            for v in re.finditer(r"\s*,\s*(?:['\"]([^'\"]*)['\"]|(\S+))", m[2]):
                if v[1] is None:
                    break
                versions.append(v[1])
            option = re.search(r"(?:groups?:|:groups?\s*=>)\s*\[?([^\]]*)", m[2])
            dev = any(groups) or "add_development" in line or bool(option and any(re.search(rf"\b{g}\b", option[1]) for g in DEV_GROUPS))
            local = re.search(r"(?:path:|:path\s*=>)\s*['\"]([^'\"]+)", m[2])
            out.dep(m[1], ", ".join(versions), "dev" if dev else "runtime", "rubygems", n, local=bool(local), at=local[1] if local else "")
        elif m := re.match(r"\s*\w+\.(name|version)\s*=\s*['\"]([^'\"]+)", line):
            if m[1] == "name":
                out.add("module", m[2], ecosystem="rubygems", line=n)
        elif m := re.match(r"\s*\w+\.executables\s*(?:<<|\+?=)\s*(.*)$", line):
            where = re.search(r"\.bindir\s*=\s*['\"]([^'\"]+)", source)
            for name in re.findall(r"['\"]([^'\"]+)['\"]", m[1]):
                out.add("entrypoint", name, posixpath.join(where[1] if where else "exe", name), line=n)


def msbuild(source: str, path: str, out: Out) -> None:
    here = posixpath.dirname(path)
    for e in ET.fromstring(re.sub(r"\sxmlns=\"[^\"]*\"", "", source.lstrip("﻿"), count=1)).iter():
        name = e.get("Include") or e.get("Update") or ""
        if e.tag in ("PackageReference", "PackageVersion") and name:
            private = (e.get("PrivateAssets") or e.findtext("PrivateAssets") or "").lower() == "all"
            out.dep(name, e.get("Version") or e.findtext("Version") or "", "build" if private else "runtime", "nuget", line_of(source, name))
        elif e.tag == "ProjectReference" and name:
            to = posixpath.normpath(posixpath.join(here, name.replace("\\", "/")))
            out.dep(posixpath.basename(to).rsplit(".", 1)[0], "", "runtime", "nuget", line_of(source, name), local=True, at=posixpath.dirname(to))
        elif e.tag == "OutputType" and (e.text or "").strip().lower() in ("exe", "winexe"):
            out.add("entrypoint", posixpath.basename(path).rsplit(".", 1)[0])
        elif e.tag in ("RootNamespace", "AssemblyName") and e.text:
            out.add("module", e.text.strip(), ecosystem="nuget")


def solution(source: str, path: str, out: Out) -> None:
    """Member projects; folders of a solution aren't members."""
    for m in re.finditer(r"^Project\(\"\{[^}]*\}\"\)\s*=\s*\"([^\"]*)\",\s*\"([^\"]*\.\w+proj)\"", source, re.M):
        out.add("workspace", m[2].replace("\\", "/"), m[1], ecosystem="nuget", line=source.count("\n", 0, m.start()) + 1)


def cmake(source: str, path: str, out: Out) -> None:
    calls, out.complete = blocks.cmake(source)
    own, linked = set(), []
    for c in calls:
        first = c.args[0] if c.args else ""
        if c.name == "project" and first:
            version = c.args[c.args.index("VERSION") + 1] if "VERSION" in c.args[:-1] else ""
            out.add("module", first, version, ecosystem="cmake", line=c.line)
        elif c.name in ("add_executable", "add_library") and first:
            if "${" in first:
                out.complete = False
                continue
            own.add(first)
            imported = bool({"IMPORTED", "ALIAS"} & set(c.args[1:3]))
            out.add("target", first, c.name, line=c.line)
            if c.name == "add_executable" and not imported:
                out.add("entrypoint", first, line=c.line)
        elif c.name == "find_package" and first:
            version = c.args[1] if len(c.args) > 1 and re.match(r"\d", c.args[1]) else ""
            out.dep(first, version, "build", "cmake", c.line, optional="REQUIRED" not in c.args)
        elif c.name in ("pkg_check_modules", "pkg_search_module"):
            for a in c.args[1:]:
                if a not in ("REQUIRED", "QUIET", "IMPORTED_TARGET", "GLOBAL", "NO_CMAKE_PATH"):
                    m = re.match(r"([^<>=]+)(.*)", a)
                    out.dep(m[1], m[2], "build", "pkg-config", c.line)
        elif c.name == "fetchcontent_declare" and first:
            tag = c.args[c.args.index("GIT_TAG") + 1] if "GIT_TAG" in c.args[:-1] else ""
            url = next((c.args[c.args.index(k) + 1] for k in ("GIT_REPOSITORY", "URL") if k in c.args[:-1]), "")
            out.dep(first, tag, "build", "cmake", c.line, source=url)
        elif c.name == "add_subdirectory" and first:
            out.dep(posixpath.basename(first), "", "build", "cmake", c.line, local=True, at=posixpath.normpath(posixpath.join(posixpath.dirname(path), first)))
        elif c.name == "add_test":
            name = c.args[c.args.index("NAME") + 1] if "NAME" in c.args[:-1] else first
            out.add("script", name, " ".join(c.args[c.args.index("COMMAND") + 1 :]) if "COMMAND" in c.args else "", scope="test", line=c.line)
        elif c.name == "target_link_libraries":
            linked += [(a, c.line) for a in c.args[1:]]
    have = own | {f.name for f in out if f.fact == "dep"}
    for a, line in linked:
        name = a.split("::")[0]
        if a in ("PRIVATE", "PUBLIC", "INTERFACE") or "${" in a or "$<" in a or a.startswith("-") or name in have or a in have:
            continue
        have.add(name)
        out.dep(name, "", "build", "cmake", line)


def bazel(source: str, path: str, out: Out) -> None:
    calls, out.complete = blocks.starlark(source)
    here = posixpath.dirname(path)
    for c in calls:
        name = c.kwargs.get("name")
        if c.name == "module" and isinstance(name, str):
            out.add("module", name, c.kwargs.get("version"), ecosystem="bazel", line=c.line)
        elif c.name == "bazel_dep" and isinstance(name, str):
            out.dep(name, c.kwargs.get("version"), "dev" if c.kwargs.get("dev_dependency") else "build", "bazel", c.line)
        elif c.name in ("http_archive", "git_repository") and isinstance(name, str):
            out.dep(name, c.kwargs.get("tag") or c.kwargs.get("commit") or "", "build", "bazel", c.line, source=c.kwargs.get("url") or c.kwargs.get("remote") or text(c.kwargs.get("urls") or ""))
        elif isinstance(name, str) and c.name not in ("load", "package", "workspace", "glob", "select"):
            out.add("target", name, c.name, line=c.line)
            if c.name.endswith("_test"):
                out.add("script", name, scope="test", line=c.line)
            elif c.name.endswith("_binary"):
                out.add("entrypoint", name, line=c.line)
            for key in ("deps", "runtime_deps", "data", "exports"):
                for label in listing(c.kwargs.get(key)):
                    if not isinstance(label, str) or "$" in label:
                        continue
                    if label.startswith("@"):
                        out.dep(re.split(r"//|:", label.lstrip("@"))[0].rstrip("~+"), "", "build" if key == "deps" else "runtime", "bazel", c.line)
                    elif label.startswith("//"):
                        pkg = label[2:].partition(":")[0]
                        out.dep(label, "", "build" if key == "deps" else "runtime", "bazel", c.line, local=True, at=pkg or here)


def tsconfig(source: str, path: str, out: Out) -> None:
    data = blocks.jsonc(source)
    here, options = posixpath.dirname(path), mapping(data.get("compilerOptions"))
    base = posixpath.normpath(posixpath.join(here, options.get("baseUrl") or "."))
    if options.get("baseUrl"):
        out.add("alias", "*", scope="base", ecosystem="npm", items=[posixpath.normpath(posixpath.join(base, "*"))])
    for pattern, targets in mapping(options.get("paths")).items():
        out.add("alias", pattern, scope="paths", ecosystem="npm", items=[posixpath.normpath(posixpath.join(base, t)) for t in listing(targets)])
    for e in listing(data.get("extends")):
        if isinstance(e, str) and e.startswith("."):
            to = posixpath.normpath(posixpath.join(here, e))
            out.add("extends", to if to.endswith(".json") else f"{to}.json")
        else:
            out.add("extends", e, scope="package")


def makefile(source: str, path: str, out: Out) -> None:
    phony = {w for m in re.finditer(r"^\.PHONY\s*:(.*(?:\\\n.*)*)", source, re.M) for w in m[1].replace("\\\n", " ").split()}
    for m in re.finditer(r"^([A-Za-z0-9][\w./%-]*(?:[ \t]+[A-Za-z0-9][\w./%-]*)*)\s*::?(?!=)[^\n]*\n?((?:\t[^\n]*)?)", source, re.M):
        for name in m[1].split():
            line = source.count("\n", 0, m.start()) + 1
            out.add("target", name, re.sub(r"^[@+-]+", "", m[2].strip()), line=line, phony=name in phony)
            if name in phony:
                out.add("entrypoint", f"make {name}", line=line)
