"""Shared SQL of the oracles: the derived views and the small vocabularies as VALUES."""
from __future__ import annotations

from docaudit import constants as C


def values(items) -> str:
    return ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)


_ORDER = ("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, "
          "l_suppkey)")

VIEWS = {
    "d_docs": """select o_orderkey doc_id, o_custkey owner_id, case when o_orderkey%6=0 then null
        when o_orderkey%11=0 then '  ' else o_orderpriority end title,
        case o_orderstatus when 'F' then 'CONCLUIDA' when 'O' then 'PROCESSANDO'
        else 'RECEBIDA' end state from orders""",
    "d_images": f"""select l_orderkey doc_id, 'word/document.xml' part, {_ORDER} seq,
        p_brand as name, case when l_partkey%5=0 then null when l_partkey%7=0 then '  '
        else p_name end alt from lineitem join part on l_partkey=p_partkey""",
    "d_tables": f"""select l_orderkey doc_id, 'word/document.xml' part, {_ORDER} table_idx,
        case when l_linenumber=7 then 0 else cast(l_quantity as int) end n_rows,
        l_returnflag='R' first_row_header from lineitem""",
    "d_headings": f"""select l_orderkey doc_id, 'word/document.xml' part, {_ORDER} seq,
        1+cast(l_quantity as int)%4 as level, l_linestatus as text from lineitem""",
    "d_links": f"""select l_orderkey doc_id, 'word/document.xml' part, {_ORDER} seq,
        case l_partkey%6 when 0 then 'Clique aqui!' when 1 then 'saiba mais'
        when 2 then concat('https://example.org/', l_partkey) when 3 then concat('doc-', l_suppkey)
        when 4 then '  ' else p_name end as text,
        case when l_suppkey%3=0 then null else concat('DOC-', l_suppkey) end target
        from lineitem join part on l_partkey=p_partkey""",
    "d_languages": """select o_orderkey doc_id, case when o_orderkey%4=0 then 'word/styles.xml'
        else 'word/document.xml' end part, 1 seq,
        case when o_custkey%2=0 then 'pt-BR' else 'en-US' end as value
        from orders where o_orderkey%4 in (0,1)""",
    "d_event_log": """select user_id analysis_id, event_id, ts, case event_type
        when 'signup' then 'RECEBIDA' when 'view' then 'PROCESSANDO' when 'purchase' then
        'CONCLUIDA' when 'error' then 'FALHOU' end state from events where event_type<>'click'""",
    "d_lines": r"""select doc_id, i-1 line_no, lang, source, l[i] line,
        regexp_replace(l[i], '^[\s\v\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+|[\s\v\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+$', '', 'g') alt
        from (select doc_id, lang, source, string_split(text, chr(10)) l,
              unnest(range(1, len(string_split(text, chr(10)))+1)) i from documents)""",
}

_WS = r"[\s\v\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+"


def norm_alt(x: str) -> str:
    """Oracle of the canonical alt form, by DuckDB's own accent stripping."""
    return f"trim(regexp_replace(lower(strip_accents({x})), '{_WS}', ' ', 'g'))"


def norm_link(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower(strip_accents({x})), "
            f"'[[:punct:]]+$', ''), '\\s+', ' ', 'g'))")


def ellipsis(x: str) -> str:
    return f"case when length({x})<=60 then {x} else concat(left({x}, 57), '...') end"


def bucket(x: str) -> str:
    return f"(('0x'||right(sha256({x}), 8))::bigint%100)::int"


def split_of(x: str) -> str:
    b = bucket(x)
    return (f"case when {b}<{C.TRAIN_BELOW} then 'treino' when {b}<{C.VALIDATION_BELOW} "
            "then 'validacao' else 'teste' end")


def alt_quality(x: str) -> str:
    clean = f"coalesce({x}, '')"
    contains = " or ".join(f"contains(lower({clean}), '{g}')" for g in C.GENERIC_ALT_TEXTS)
    starts = " or ".join(f"starts_with(lower({clean}), '{g}')" for g in C.GENERIC_ALT_TEXTS)
    return (f"case when regexp_matches({clean}, '{C.SERVED_FILE_NAME}') or "
            f"regexp_matches({clean}, '{C.NOISE_ONLY}') then 'INSUFFICIENT' "
            f"when length({clean})<15 and ({contains}) then 'INSUFFICIENT' "
            f"when {starts} then 'WEAK' when length({clean})<15 then 'WEAK' "
            f"when length({clean})>=40 then 'GOOD' else 'WEAK' end")


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[^\p{{L}}\p{{N}}_]+'), lambda t: t<>'')"


def repeats_word(x: str) -> str:
    long = f"list_transform(list_filter({tokens(x)}, lambda t: length(t)>3), lambda t: lower(t))"
    return f"(len({long})>=2 and len(list_distinct({long}))<len({long}))"


def has_structure(x: str) -> str:
    return (f"(len({tokens(x)})>=4 and len(list_filter({tokens(x)}, lambda t: length(t)>=4 and "
            rf"regexp_matches(t, '[\p{{L}}\p{{Nl}}\p{{No}}]')))>0)")


def provisional(x: str) -> str:
    n = norm_alt(x)
    blocked = f"[{values(C.BLOCKED_TERMS)}]"
    return (f"case when length({x})<10 then 'INSUFFICIENT' "
            f"when len({tokens(n)})>0 and list_has_all({blocked}, {tokens(n)}) then 'INSUFFICIENT' "
            f"when {n} in ({values(C.BLOCKED_TERMS)}) then 'INSUFFICIENT' "
            f"when length({x})<=30 or {repeats_word(x)} then 'WEAK' "
            f"when not {has_structure(x)} then 'WEAK' else 'GOOD' end")


def insufficient_reason(x: str) -> str:
    return (f"case when {x}='' then null when regexp_matches({x}, '{C.WEB_HASH}') then 'hash' "
            f"when regexp_matches({x}, '{C.WEB_FILE_NAME}') then 'nome_de_arquivo' "
            f"when not regexp_matches({x}, '{C.HAS_LETTER}') then 'sem_letra' "
            f"when {norm_alt(x)} in ({values(C.SOLO_TERMS)}) then 'termo_generico_solto' "
            f"when length({x})<6 then 'curto_demais' end")


_FINDINGS = {
    "image": """select doc_id, 'IMAGEM_SEM_TEXTO_ALTERNATIVO' rule_id, '1.1.1' criterion,
        'A' as level, 'ALTA' severity, part, concat('imagem ''', case when trim(name)='' then
        '(sem nome)' else name end, ''' nao tem atributo de texto alternativo (descr)') evidence
        from d_images where alt is null""",
    "table": """select doc_id, 'TABELA_SEM_CABECALHO' rule_id, '1.3.1' criterion, 'A' as level,
        'ALTA' severity, part, concat('tabela ', table_idx, ' (', n_rows,
        ' linhas) nao marca a primeira linha como cabecalho (w:tblHeader)') evidence
        from d_tables where n_rows>0 and not first_row_header""",
    "heading": """select doc_id, 'ORDEM_HIERARQUICA_CABECALHOS' rule_id, '1.3.1' criterion,
        'A' as level, 'MEDIA' severity, part, concat(case when b=0 then concat(
        'o primeiro titulo do documento e H', level, ', e nao H1') else concat('titulo H', level,
        ' vem logo depois de um H', b) end, ' — ''', text, '''') evidence
        from (select *, lag(level, 1, 0) over (partition by doc_id order by seq) b
              from d_headings) where level>b+1""",
    "title": """select doc_id, 'TITULO_AUSENTE' rule_id, '2.4.2' criterion, 'A' as level,
        'MEDIA' severity, 'docProps/core.xml' part, case when title is null then
        'o pacote nao declara dc:title em docProps/core.xml' else
        'dc:title existe em docProps/core.xml mas esta em branco' end evidence
        from d_docs where title is null or trim(title)=''""",
    "link": f"""select doc_id, 'LINK_SEM_TEXTO_DESCRITIVO' rule_id, '2.4.4' criterion,
        'A' as level, 'MEDIA' severity, part, concat(case when {norm_link('t')} in
        ({values(C.GENERIC_LINK_TEXTS)}) then concat('texto de link generico: ''', t, '''')
        else concat('o texto do link e a propria URL: ''', {ellipsis('t')}, '''') end,
        case when target is not null then concat(' (destino: ', {ellipsis('target')}, ')')
        else '' end) evidence from (select *, trim(text) t from d_links) where t<>'' and
        ({norm_link('t')} in ({values(C.GENERIC_LINK_TEXTS)}) or regexp_matches(lower(t),
        '{C.URL_START}') or lower(t)=lower(coalesce(target, '')))""",
    "language": """select doc_id, 'IDIOMA_NAO_DECLARADO' rule_id, '3.1.1' criterion, 'A' as level,
        'ALTA' severity, 'word/styles.xml' part, case when v is null then
        'o documento nao declara idioma em lugar nenhum (w:lang ausente)' else concat(
        'ha idioma declarado apenas em trechos (', v,
        '), mas nao no padrao do documento em word/styles.xml') end evidence
        from d_docs left join (select doc_id, bool_or(part='word/styles.xml') d,
        string_agg(distinct value, ', ') v from d_languages group by 1) using (doc_id)
        where d is null or not d""",
}
VIEWS |= {f"f_{k}": v for k, v in _FINDINGS.items()}
VIEWS["findings"] = " union all ".join(f"select * from f_{k}" for k in _FINDINGS)
VIEWS["principle_scores"] = """select doc_id, principle, title,
    greatest(0, 100-coalesce(penalty, 0))::bigint score, 25 weight,
    coalesce(problems, 0)::bigint problems, coalesce(penalty, 0)::bigint penalty
    from (select doc_id, p.* from d_docs, (values ('1', 'PERCEPTIVEL', 'Perceptivel'),
          ('2', 'OPERAVEL', 'Operavel'), ('3', 'COMPREENSIVEL', 'Compreensivel'))
          p(digit, principle, title))
    left join (select doc_id, left(criterion, 1) digit, count(*) problems,
               sum(case severity when 'CRITICA' then 25 when 'ALTA' then 15 when 'MEDIA' then 8
                   else 3 end) penalty from findings group by 1, 2) using (doc_id, digit)"""
VIEWS["global_scores"] = """select doc_id, floor(sum(score*weight)/nullif(sum(weight), 0)+0.5)
    ::bigint global_score, 'ROBUSTO' not_evaluated from principle_scores group by doc_id"""

_NEEDS = {
    **{f"f_{k}": [v] for k, v in zip(_FINDINGS, (
        "d_images", "d_tables", "d_headings", "d_docs", "d_links", "d_docs"))},
    "findings": [f"f_{k}" for k in _FINDINGS],
    "principle_scores": ["d_docs", "findings"],
    "global_scores": ["principle_scores"],
}
_NEEDS["f_language"] = ["d_docs", "d_languages"]


def add_view(name: str, sql: str, needs: list[str]) -> None:
    VIEWS[name] = sql
    _NEEDS[name] = needs


def with_views(sql: str, *names: str) -> str:
    """The query with the named views, and those they read, in front as CTEs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in ordered) + f"\n{sql}"


_GROUP = "case when n<>'' then n else concat('__sem_alt__', file) end"
add_view("d_rows", f"""select *, {split_of('group_key')} split, case when alt<>'' then
    {provisional('alt')} end provisional_label, case when label is not null then 'humano' end
    label_origin from (select *, {_GROUP} group_key from (select doc_id*100000+line_no ord, doc_id,
    concat('doc-', doc_id, '.docx#', line_no) id, concat('doc-', doc_id, '.docx') file, alt, lang,
    {norm_alt('alt')} n, case when doc_id%4 in (1,2) then 'wikimedia-commons' when doc_id%4=3 then
    'web' end source, case when doc_id%4=3 and line_no%2=0 then 'sintetico_fallback' when doc_id%4=3
    then 'coletado' end data_origin, case when (doc_id+line_no)%3=0 then case when quality=1 then
    'GOOD' when toxic=1 then 'INSUFFICIENT' when quality=0 then 'WEAK' end end as label
    from d_lines left join labels using (doc_id)))""", ["d_lines"])
