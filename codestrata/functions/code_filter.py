"""Is a file code? An ordered decision on path and content, as one column expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of source code, extensions that are no code, path parts
# that are skipped, names that are code without an extension, suffixes that count as their last part.
CODE = (
    ".py .pyw .pyi .js .mjs .cjs .ts .tsx .jsx .rs .go .java .c .cpp .cc .cxx .h .hpp .hxx .c++ .h++ .cs .m .mm .rb .rake .gemspec .php .phtml .swift .kt .kts .scala .sc "
    ".clj .cljs .cljc .edn .ex .exs .erl .hrl .hs .lhs .ml .mli .fs .fsx .fsi .pl .pm .pod .lua .r .R .jl .nim .nims .zig .v .d .dart .vue .svelte .elm .sol .sql .pgsql .plsql "
    ".mysql .sh .bash .zsh .fish .csh .tcsh .ksh .ps1 .psm1 .psd1 .bat .cmd .asm .s .S .groovy .gradle .gvy .f .f90 .f95 .f03 .f08 .for .ftn .vb .vbs .bas .coffee .litcoffee "
    ".proto .graphql .gql .tf .tfvars .hcl .bicep .nix .purs .cr .hx .wasm .wat .lisp .lsp .cl .scm .ss .rkt .ada .adb .ads .cob .cbl .pas .dpr .tcl .awk .sed .vhd .vhdl .sv .svh "
    ".as .mxml .dhall .mk"
).split()
SKIP = (
    ".md .markdown .rst .txt .json .yaml .yml .toml .xml .html .htm .css .scss .sass .less .log .out .env .env.local .env.example .lock .sum .min.js .min.css .map .png .jpg .jpeg "
    ".gif .svg .ico .woff .woff2 .ttf .eot .pdf .doc .docx .csv .tsv"
).split()
SKIP_PATHS = "artifacts/ docs/ documentation/ research/ test_data/ __pycache__/ .git/ .venv/ venv/ node_modules/ .mypy_cache/ .pytest_cache/ dist/ build/ .egg-info/ migrations/".split()
NAMES = (
    "Makefile GNUmakefile BSDmakefile makefile Dockerfile Containerfile Jenkinsfile Vagrantfile Rakefile Gemfile Guardfile Brewfile Berksfile Fastfile Appfile Deliverfile Matchfile "
    "Scanfile Gruntfile Gulpfile Procfile Justfile Cakefile Snakefile SConstruct SConscript Thorfile Puppetfile Capfile Buildfile Jarfile"
).split()
COMPOUND = ".test.js .test.ts .spec.js .spec.ts .test.py .spec.py .stories.js .stories.tsx".split()
STRONG = [
    r"\bdef\s+\w+\s*\(", r"\bfunction\s+\w*\s*\(", r"\bfn\s+\w+\s*\(", r"\bfunc\s+\w+\s*\(", r"\bsub\s+\w+\s*[\(\{]", r"\bclass\s+\w+", r"\bstruct\s+\w+", r"\btrait\s+\w+", r"\binterface\s+\w+",
]
WEAK = [
    r"\b(import|from|require|use|include)\b", r"\b(if|else|for|while|return|try|catch)\b", r"\b(const|let|var|val|mut)\s+\w+\s*[=:]", r"(?m);\s*$", r"=>|lambda",
    r":\s*(str|int|bool|float|string|number|boolean|i32|u32|Vec)", r"(?m)^@\w+",
]
SHEBANGS = r"^#!\s*(/usr/bin/env\s+\w+|/bin/(ba)?sh|/usr/bin/python|/usr/bin/perl|/usr/bin/ruby|/usr/bin/node)"


@dataclass
class FilterConfig:
    code: list[str] = field(default_factory=lambda: list(CODE))
    skip: list[str] = field(default_factory=lambda: list(SKIP))
    skip_paths: list[str] = field(default_factory=lambda: list(SKIP_PATHS))
    names: list[str] = field(default_factory=lambda: list(NAMES))

    @staticmethod
    def layered(provided: dict | None = None, file: dict | None = None) -> FilterConfig:
        """Provided values over those of a file over the defaults."""
        out = FilterConfig()
        for layer in (file or {}, provided or {}):
            for k in ("code", "skip", "skip_paths", "names"):
                if layer.get(k) is not None:
                    setattr(out, k, list(layer[k]))
        return out

    def add_code_extension(self, ext: str) -> None:
        ext = ext if ext.startswith(".") else f".{ext}"
        self.code.append(ext)
        self.skip = [x for x in self.skip if x != ext]

    def add_skip_extension(self, ext: str) -> None:
        ext = ext if ext.startswith(".") else f".{ext}"
        self.skip.append(ext)
        self.code = [x for x in self.code if x != ext]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"/+$", ""), "/"), -1)


def extension(path: Column) -> Column:
    """'' without a dot; the whole name of a dotfile; the last part of known compounds as it is; else the last suffix in lower case."""
    name = base_name(path)
    parts = F.split(name, r"\.")
    compound = F.concat(F.lit("."), F.element_at(F.slice(parts, -2, 2), 1), F.lit("."), F.element_at(parts, -1))
    suffix = F.regexp_extract(F.regexp_replace(name, r"^\.+", ""), r"(\.[^.]+)$", 1)
    return (
        F.when(~name.contains("."), "")
        .when(name.startswith(".") & (F.size(parts) == 2), name)
        .when(compound.isin(*COMPOUND), F.concat(F.lit("."), F.element_at(parts, -1)))
        .otherwise(F.lower(suffix))
    )


def content_score(content: Column) -> Column:
    """Indicators of code: 2 for a definition, 1 for each weaker sign (the shebang is apart)."""
    score = F.lit(0)
    for p in STRONG:
        score = score + F.when(content.rlike(p), 2).otherwise(0)
    for p in WEAK:
        score = score + F.when(content.rlike(p), 1).otherwise(0)
    brackets = F.length(content) - F.length(F.translate(content, "{}[]", ""))
    return score + F.when(brackets / F.greatest(F.length(content), F.lit(1)) > 0.02, 1).otherwise(0)


def looks_like_code(content: Column) -> Column:
    stripped = F.regexp_replace(content, r"^\s+|\s+$", "")
    return F.when(F.length(stripped) < 20, False).when(F.regexp_replace(content, r"^\s+", "").rlike(SHEBANGS), True).otherwise(content_score(content) >= 2)


def is_code(path: Column, content: Column | None = None, config: FilterConfig | None = None) -> Column:
    c = config or FilterConfig()
    skipped = F.lit(False)
    for part in c.skip_paths:
        skipped = skipped | path.contains(part)
    name, ext = base_name(path), extension(path)
    unknown = F.lit(False) if content is None else F.when(content.isNull(), False).otherwise(looks_like_code(content))
    return F.when(skipped, False).when(name.contains(".min."), False).when(name.isin(*c.names), True).when(ext.isin(*c.skip), False).when(ext.isin(*c.code), True).otherwise(unknown)
