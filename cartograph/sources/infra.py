"""Manifests of running things: images, compose files, workflows, Kubernetes, Helm, Terraform. Names and keys only, never values."""

from __future__ import annotations

import posixpath
import re

from cartograph.sources.facts import Out, get, keys_of, listing, mapping, sensitive, text
from cartograph.sources.readers import blocks, yaml

# Instructions of a container file; kinds of Kubernetes objects that run pods.
INSTRUCTIONS = (
    "FROM", "RUN", "CMD", "LABEL", "MAINTAINER", "EXPOSE", "ENV", "ADD", "COPY", "ENTRYPOINT", "VOLUME", "USER", "WORKDIR", "ARG", "ONBUILD", "STOPSIGNAL", "HEALTHCHECK", "SHELL",
)
WORKLOADS = ("Deployment", "StatefulSet", "DaemonSet", "ReplicaSet", "Pod", "Job", "CronJob", "ReplicationController")
# Terraform type endings that run something, and endings that look alike but don't.
RUNS = ("_instance", "_service", "_function", "_deployment", "_cluster", "_job", "_app", "_container", "_pod", "_stateful_set", "_daemonset", "_virtual_machine", "_web_app", "_app_service")
RUNS_NOT = ("_db_instance", "_security_service", "_service_account", "_project_service", "_vpc_endpoint_service")


def split_image(image: str) -> tuple[str, str]:
    """(name, tag or digest)."""
    if "@" in image:
        name, _, tag = image.partition("@")
        return name, tag
    name, sep, tag = image.rpartition(":")
    return (name, tag) if sep and "/" not in tag else (image, "")


def containerfile(source: str, path: str, out: Out) -> None:
    args: dict[str, str] = {}
    stages: set[str] = set()
    joined = re.sub(r"\\[ \t]*\n(\s*#[^\n]*\n)*", " ", re.sub(r"(?m)^\s*#.*$", "", source))
    here = None
    for line in joined.split("\n"):
        if here:
            here = None if line.strip() == here else here
            continue
        m = re.match(r"\s*([A-Za-z]+)\s+(.*)$", line)
        if not m:
            continue
        word, rest = m[1].upper(), m[2].strip()
        if word not in INSTRUCTIONS:
            out.complete = False
            continue
        if h := re.search(r"<<-?['\"]?(\w+)", rest):
            here = h[1]
        if word == "ARG":
            k, _, v = rest.partition("=")
            args.setdefault(k.strip(), v.strip().strip("\"'"))
        elif word == "FROM":
            words = [w for w in rest.split() if not w.startswith("--")]
            image = re.sub(r"\$\{?(\w+)(?::-([^}]*))?\}?", lambda x: args.get(x[1]) or x[2] or x[0], words[0]) if words else ""
            if image.lower() not in stages and image:
                name, tag = split_image(image)
                out.add("image", name, tag, scope=words[2] if len(words) > 2 and words[1].upper() == "AS" else "")
                if "$" in image:
                    out.complete = False
            if len(words) > 2 and words[1].upper() == "AS":
                stages.add(words[2].lower())
        elif word in ("COPY", "ADD"):
            f = re.search(r"--from=(\S+)", rest)
            if f and f[1].lower() not in stages and not f[1].isdigit() and "$" not in f[1]:
                out.add("image", *split_image(f[1]), scope="copy")
        elif word == "EXPOSE":
            for p in rest.split():
                out.add("port", p)
        elif word == "ENV":
            for k in re.findall(r"(?:^|\s)([A-Za-z_]\w*)=", rest) or rest.split()[:1]:
                out.add("env", k)
                if sensitive(k):
                    out.add("secret", k, scope="env")
        elif word in ("ENTRYPOINT", "CMD"):
            out.add("entrypoint", word.lower(), re.sub(r"[\[\]\",]+", " ", rest).strip())


def compose(source: str, path: str, out: Out) -> None:
    docs, out.complete = yaml.read(source)
    for doc in docs:
        for name, s in mapping(get(doc, "services")).items():
            s = mapping(s)
            build = s.get("build")
            where = build if isinstance(build, str) else text(get(build, "context"))
            if isinstance(build, dict) and build.get("dockerfile"):
                where = posixpath.join(where or ".", text(build["dockerfile"]))
            ports = [text(p) if isinstance(p, str) else ":".join(x for x in (text(get(p, "published")), text(get(p, "target"))) if x) for p in listing(s.get("ports"))]
            env = keys_of(s.get("environment")) + keys_of(get(build, "args"))
            volumes = [v if isinstance(v, str) else text(get(v, "source")) for v in listing(s.get("volumes"))]
            out.add("service", name, s.get("image") or "", line=getattr(mapping(get(doc, "services")), "lines", {}).get(name, 0), items=ports, build=where, env=sorted(set(env)), volumes=volumes, replicas=text(get(s, "deploy", "replicas")))
            for d in s["depends_on"] if isinstance(s.get("depends_on"), (dict, list)) else listing(s.get("depends_on")):
                out.add("service_dep", name, d)
            for x in listing(s.get("secrets")):
                out.add("secret", x if isinstance(x, str) else text(get(x, "source")), scope=name)
            for x in listing(s.get("env_file")):
                out.add("secret", x if isinstance(x, str) else text(get(x, "path")), scope=name, value="env_file")
            for k in env:
                if sensitive(k):
                    out.add("secret", k, scope=name, value="env")


def gate(on, branches: tuple[str, ...] = ("main", "master", "trunk", "develop")) -> bool:
    """Whether triggers guard what gets merged: pull requests, merge groups, or pushes to a default branch or without a tag filter."""
    names = list(on) if isinstance(on, dict) else [x for x in listing(on) if isinstance(x, str)]
    if {"pull_request", "pull_request_target", "merge_group"} & set(names):
        return True
    if "push" not in names:
        return False
    push = mapping(get(on, "push"))
    if push.get("branches"):
        return any(b in branches or b in ("*", "**") for b in listing(push["branches"]))
    return not push.get("tags")


def workflow(source: str, path: str, out: Out) -> None:
    docs, out.complete = yaml.read(source)
    for doc in filter(lambda d: isinstance(d, dict), docs):
        on = next((doc[k] for k in ("on", "true", "True") if k in doc), None)
        guard, title = gate(on), text(doc.get("name")) or posixpath.basename(path).rsplit(".", 1)[0]

        def permissions(p) -> list[str]:
            return [p] if isinstance(p, str) and p else [f"{k}:{text(v)}" for k, v in mapping(p).items()]

        def steps(key: str, rows) -> int:
            for n, st in enumerate(filter(lambda x: isinstance(x, dict), listing(rows))):
                uses = text(st.get("uses"))
                out.add("step", text(st.get("name")) or uses or text(st.get("id")) or text(st.get("run")).split("\n")[0], uses or text(st.get("run")).split("\n")[0], scope=key, line=n, uses=uses, run=text(st.get("run")).strip())
                action(uses)
                for ref in re.findall(r"secrets\.(\w+)", " ".join([text(st.get("run")), *map(text, mapping(st.get("with")).values()), *map(text, mapping(st.get("env")).values())])):
                    out.add("secret", ref, scope=key)
            return len(listing(rows))

        def action(uses: str) -> None:
            if uses and not uses.startswith(("./", "docker://")):
                name, _, version = uses.rpartition("@")
                out.dep(name or uses, version if name else "", "build", "github-actions")

        for key, j in mapping(doc.get("jobs")).items():
            j = mapping(j)
            uses = text(j.get("uses"))
            n = steps(key, j.get("steps"))
            action(uses)
            runner = j.get("runs-on")
            out.add("job", text(j.get("name")) or key, key, items=listing(j.get("needs")), workflow=title, runner=text(get(runner, "labels") or runner if isinstance(runner, dict) else runner), uses=uses, steps=str(n), gate=guard, permissions=permissions(j["permissions"] if "permissions" in j else doc.get("permissions")))
        if isinstance(doc.get("runs"), dict):
            steps("runs", doc["runs"].get("steps"))


def _pod(spec: dict) -> dict:
    for at in (("template", "spec"), ("jobTemplate", "spec", "template", "spec")):
        if isinstance(get(spec, *at), dict):
            return get(spec, *at)
    return spec


def kubernetes(source: str, path: str, out: Out) -> None:
    docs, out.complete = yaml.read(source)
    flat = [x for d in docs for x in (listing(d.get("items")) if isinstance(d, dict) and d.get("kind") == "List" else [d])]
    for d in flat:
        if not (isinstance(d, dict) and d.get("apiVersion") and isinstance(d.get("kind"), str)):
            continue
        kind, name, space, spec = d["kind"], text(get(d, "metadata", "name")), text(get(d, "metadata", "namespace")), mapping(d.get("spec"))
        if not name:
            out.complete = False
            continue
        if kind in WORKLOADS:
            boxes = [mapping(c) for k in ("initContainers", "containers") for c in listing(_pod(spec).get(k))]
            env = sorted({text(get(e, "name")) for c in boxes for e in listing(c.get("env"))} - {""})
            ports = [text(get(p, "containerPort")) for c in boxes for p in listing(c.get("ports"))]
            images = [text(c.get("image")) for c in boxes if c.get("image")]
            out.add("service", name, ", ".join(images), items=ports, kind=kind, namespace=space, replicas=text(spec.get("replicas")), env=env, volumes=[text(get(v, "name")) for v in listing(_pod(spec).get("volumes"))])
            for c in boxes:
                for ref in [get(e, "valueFrom", "secretKeyRef") for e in listing(c.get("env"))] + [get(e, "secretRef") for e in listing(c.get("envFrom"))]:
                    if text(get(ref, "name")):
                        out.add("secret", get(ref, "name"), get(ref, "key") or "", scope=name)
            for v in listing(_pod(spec).get("volumes")):
                if get(v, "secret", "secretName"):
                    out.add("secret", get(v, "secret", "secretName"), scope=name)
        elif kind == "Service":
            out.add("service", name, kind="Service", namespace=space, items=[text(get(p, "port")) for p in listing(spec.get("ports"))])
            for k, v in mapping(spec.get("selector")).items():
                out.add("service_dep", name, f"{k}={text(v)}")
        elif kind == "Ingress":
            out.add("service", name, kind="Ingress", namespace=space)
            for r in listing(spec.get("rules")):
                for p in listing(get(r, "http", "paths")):
                    out.add("service_dep", name, get(p, "backend", "service", "name") or get(p, "backend", "serviceName") or "")
        elif kind in ("ConfigMap", "Secret"):
            keys = sorted({*mapping(d.get("data")), *mapping(d.get("stringData"))})
            out.add("service", name, kind=kind, namespace=space, env=keys)
            if kind == "Secret":
                for k in keys:
                    out.add("secret", name, k, scope=name)
        elif kind == "CustomResourceDefinition":
            out.add("contract", text(get(spec, "names", "kind")) or name, scope="crd")


def helm_chart(source: str, path: str, out: Out) -> None:
    docs, out.complete = yaml.read(source)
    for d in filter(lambda x: isinstance(x, dict), docs):
        if d.get("name"):
            out.add("module", d["name"], d.get("version", ""), ecosystem="helm", app=d.get("appVersion", ""))
        for x in listing(d.get("dependencies")):
            repo = text(get(x, "repository"))
            out.dep(get(x, "name"), get(x, "version") or "", "runtime", "helm", source=repo, local=repo.startswith("file://"), at=repo.removeprefix("file://") if repo.startswith("file://") else "")


def helm_values(source: str, path: str, out: Out) -> None:
    """Images that values name, and keys that sound secret."""
    docs, out.complete = yaml.read(source)

    def walk(v, at: tuple[str, ...]) -> None:
        if isinstance(v, dict):
            if isinstance(v.get("repository"), str) and ("tag" in v or "digest" in v or at[-1:] == ("image",)):
                out.add("image", v["repository"], text(v.get("tag")) or text(v.get("digest")), scope=".".join(at))
            for k, x in v.items():
                if sensitive(str(k)) and not isinstance(x, dict):
                    out.add("secret", ".".join((*at, str(k))), scope="values")
                walk(x, (*at, str(k)))
        elif isinstance(v, list):
            for x in v:
                walk(x, at)

    for d in docs:
        walk(d, ())
    chart = posixpath.basename(posixpath.dirname(path)) or "values"
    out.add("service", chart, kind="helm-values")


def terraform(source: str, path: str, out: Out) -> None:
    top, out.complete = blocks.hcl(source)
    if path.endswith(".tfvars"):
        for k in top.attrs:
            out.add("env", k)
            if sensitive(k):
                out.add("secret", k, scope="tfvars")
        return
    pinned: set[str] = set()
    for b in top.blocks:
        for inner in b.blocks if b.kind == "terraform" else []:
            if inner.kind == "required_providers":
                for k, v in inner.attrs.items():
                    pinned.add(k)
                    out.dep(text(get(v, "source")) or k, text(get(v, "version")) if isinstance(v, dict) else text(v), "build", "terraform", inner.line)
    for b in top.blocks:
        label = b.labels[0] if b.labels else ""
        if b.kind == "module" and label:
            src = text(b.attrs.get("source"))
            local = src.startswith(".")
            out.dep(label if local else src.split("?")[0], text(b.attrs.get("version")), "build", "terraform", b.line, local=local, at=posixpath.normpath(posixpath.join(posixpath.dirname(path), src)) if local else "", source="" if local else src)
        elif b.kind == "provider" and label and label not in pinned:
            pinned.add(label)
            out.dep(label, text(b.attrs.get("version")), "build", "terraform", b.line)
        elif b.kind == "resource" and len(b.labels) == 2:
            if label.endswith(RUNS) and not label.endswith(RUNS_NOT):
                out.add("service", b.labels[1], text(b.attrs.get("image")), line=b.line, kind=label)
            if sensitive(label):
                out.add("secret", b.labels[1], scope=label, line=b.line)
        elif b.kind == "variable" and label:
            out.add("variable", label, text(b.attrs.get("type")), line=b.line)
            if sensitive(label) or text(b.attrs.get("sensitive")) == "true":
                out.add("secret", label, scope="variable", line=b.line)
