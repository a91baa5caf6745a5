"""Reports bundled the way the dashboard asks for them: name -> DataFrame.

``filters`` are the six dashboard filters. The statistics and the socioeconomic bundle come
from the stored cube if it is given, and then read no rows; else they read the rows at once,
when asked for. Every other report reads when a caller acts on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from microatlas import config
from microatlas.operators import evaluate
from microatlas.operators.filters import require
from microatlas.plans import cube
from microatlas.plans import reports as r
from microatlas.runtime import settle

Bundle = dict[str, DataFrame]


def estatisticas(fact: DataFrame | None, filters: r.Filters = None, stored: DataFrame | None = None) -> Bundle:
    """All statistics, from the stored cube or cut from one settled pass over the rows."""
    if stored is not None:
        return cube.statistics(stored, filters)
    return r.statistics_of_cube(settle(r.statistics_cube(fact, filters), "statistics"))


def socioeconomico(fact: DataFrame | None, filters: r.Filters = None, stored: DataFrame | None = None) -> Bundle:
    """All socioeconomic reports, from the stored cube or cut from one settled pass over the rows."""
    if stored is not None:
        return cube.socioeconomic(stored, filters)
    return r.socioeconomic_of_cells(settle(r.socioeconomic_in_one_scan(fact, filters), "socioeconomic"))


def clusters(fact: DataFrame, filters: r.Filters = None) -> Bundle:
    return {
        "pontos": r.projection_points(fact, filters),
        "stats_por_cluster": r.cluster_statistics(fact, filters),
        "composicao": r.cluster_bands(fact, filters),
        "radar": r.cluster_radar(fact, filters),
    }


def ml_metricas(metrics: DataFrame) -> Bundle:
    return {
        "acuracia": evaluate.metric_accuracy(metrics),
        "importancias": evaluate.metric_importances(metrics),
        "importancias_nomeadas": r.feature_importance(metrics),
        "metricas_classe": evaluate.metric_classes(metrics),
        "matriz_confusao": evaluate.metric_matrix(metrics),
    }


def filtros(
    fact: DataFrame, municipalities: DataFrame | None = None, regiao=None, uf=None
) -> Bundle:
    """Options of one level: municipalities of a state, states of a region, or the top level."""
    if uf not in (None, ""):
        if municipalities is None:
            raise ValueError("municipalities are needed to list those of a state")
        return {"municipios": r.municipality_options(fact, municipalities, uf)}
    if regiao not in (None, ""):
        return {"ufs": r.state_options(fact, regiao)}
    return {
        "ufs": r.state_options(fact),
        "cursos": r.course_options(fact),
        "tipos": r.type_options(fact),
    }


def habitos(fact: DataFrame, filters: r.Filters = None) -> Bundle:
    return {
        "total": r.total_students(require(fact, r.SCORE), filters),
        "habitos": r.habits(fact, filters),
    }


def raca(fact: DataFrame, filters: r.Filters = None) -> Bundle:
    return {
        "total": r.total_students(require(fact, r.SCORE), filters),
        "raca": r.race(fact, filters),
        "desempenho": r.race_performance(fact, filters),
        "destaques": r.best_and_largest_race(fact, filters),
    }


def visao_geral(fact: DataFrame, raw: DataFrame, raw_year: str = "nu_ano") -> Bundle:
    return {
        "modalidade": r.modality_by_year(fact),
        "rede": r.network_by_year(fact),
        "por_uf": r.by_state(fact),
        "por_regiao": r.by_region_of_state(fact),
        "cobertura": r.coverage(fact, raw, raw_year),
        "resumo": r.coverage_summary(fact, raw, raw_year),
    }


def analise(fact: DataFrame, years: Sequence[int] = config.EDITIONS) -> Bundle:
    return {
        "evolucao_por_curso": r.course_over_time_pivot(fact, years),
        "evolucao_linhas": r.course_over_time(fact),
        "renda_vs_faixa": r.income_by_band(fact),
        "acesso_internet": r.internet_access(fact),
        "histograma": r.score_histogram(fact, years),
        "matriz_confusao": r.confusion(fact),
        "correlacao_renda": r.income_score_correlation(fact),
        "variacao_anual": r.yearly_change(fact),
    }


def bivariado(fact: DataFrame) -> Bundle:
    return {
        "renda_vs_rede": r.income_by_network(fact),
        "curso_vs_rede": r.course_by_network(fact),
        "raca_vs_renda": r.race_by_income_nested(fact),
        "fin_vs_rede": r.funding_by_network(fact),
        "composicao_racial_renda": r.race_within_income_pivot(fact),
        "maior_delta": r.largest_network_gap(fact),
    }


def previsao(
    fact: DataFrame,
    real: Sequence[int] = config.EDITIONS,
    projected: Sequence[int] = config.PROJECTED_EDITIONS,
) -> Bundle:
    return {
        "tendencia_geral": r.overall_trend(fact, real, projected),
        "tendencia_cursos": r.course_trends(fact, real, projected),
        "tendencia_rede": r.network_trends(fact, real, projected),
        "tendencia_rede_pivot": r.network_trends_pivot(fact, real, projected),
        "resumo": r.trend_summary(fact, real, projected),
    }


def genero(fact: DataFrame, column: str, values: tuple[str, str] = ("F", "M"), filters: r.Filters = None) -> Bundle:
    """A two-valued column against race."""
    return {
        "total": r.total_students(require(fact, r.SCORE), filters),
        "genero": r.binary_split(fact, column, filters=filters),
        "raca": r.race(fact, filters),
        "cruzamento": r.binary_by_race(fact, column, values, filters),
    }
