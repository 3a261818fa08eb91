"""Readable exports: column selections with headers, ordered, written as quoted CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.operators.search import evidence_policies, policy_rules

# Header and column of each export, in file order.
HEADERS = {
    "sources": "来源名称=name 层级=level 地区=jurisdiction_name 首页=base_url 栏目地址=listing_url 类型=source_type 频率=frequency 最近采集时间=last_fetched_at",
    "policies": "政策标题=title 主题=program 层级=policy_level 发布机关=issuer 适用地区=jurisdiction_name 品类=category 补贴方式=amount_type 比例%=rate 固定金额元=fixed_amount 最高金额元=cap_amount 生效日期=effective_from 截止日期=effective_to 状态=status 官方来源=source_url",
    "evidence": "政策标题=policy_title 字段=field_name 原文引文=quote 页码=page_number 置信度=confidence",
    "aggregates": "地区=jurisdiction_name 主题=program 统计类型=metric_type 金额元=amount_yuan 数量=count_value 单位=unit 截止日期=as_of_date 官方来源=source_url 原文引文=quote",
    "contributions": "标题=title 提交人ID=user_id 状态=status 地区=jurisdiction_name 品类=category 审核人ID=reviewer_id 审核时间=reviewed_at 更新时间=updated_at",
    "documents": "标题=title 网址=url 文件类型=mime_type 哈希=content_hash 状态=status 错误=error 采集时间=fetched_at 解析时间=parsed_at",
    "import_runs": "数据包=pack_id 版本=pack_version 路径=pack_path 摘要=summary_json 是否预演=dry_run 导入时间=created_at",
    "users": "用户名=username 显示名称=display_name 角色=role 状态=status 创建时间=created_at",
    "invites": "邀请码=code 角色=role 备注=note 有效期=expires_at 使用者=used_by_username 使用时间=used_at 创建时间=created_at",
}


def _select(df: DataFrame, export: str, order: Sequence[Column]) -> DataFrame:
    pairs = [item.split("=") for item in HEADERS[export].split()]
    return df.orderBy(*order).select(*[F.col(column).alias(header) for header, column in pairs])


def _up(name: str) -> Column:
    return F.col(name).asc_nulls_first()


def _down(name: str) -> Column:
    return F.col(name).desc_nulls_last()


def export_sources(sources: DataFrame) -> DataFrame:
    return _select(sources, "sources", [_up("level"), _up("name")])


def export_policies(policies: DataFrame, rules: DataFrame) -> DataFrame:
    side = rules.select("policy_id", "category", "amount_type", "rate", "fixed_amount", "cap_amount")
    return _select(policy_rules(policies, side), "policies", [_down("effective_from"), _up("title")])


def export_evidence(evidence: DataFrame, policies: DataFrame) -> DataFrame:
    return _select(evidence_policies(evidence, policies), "evidence", [_up("policy_title"), _up("field_name")])


def export_aggregates(aggregates: DataFrame) -> DataFrame:
    return _select(aggregates, "aggregates", [_down("as_of_date"), _up("metric_type")])


def export_contributions(contributions: DataFrame) -> DataFrame:
    return _select(contributions, "contributions", [_down("updated_at")])


def export_documents(documents: DataFrame) -> DataFrame:
    return _select(documents, "documents", [_down("created_at")])


def export_import_runs(runs: DataFrame) -> DataFrame:
    return _select(runs, "import_runs", [_down("created_at")])


def export_users(users: DataFrame) -> DataFrame:
    return _select(users, "users", [_up("created_at")])


def export_invites(invites: DataFrame, users: DataFrame) -> DataFrame:
    names = users.select(F.col("id").alias("used_by"), F.col("username").alias("used_by_username"))
    return _select(invites.join(names, "used_by", "left"), "invites", [_down("created_at")])


def write_export(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Quoted CSV with a header; nested values as JSON, null as empty.

    Spark writes UTF-8 without byte order mark and with plain line feeds, one file per task.
    """
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("struct", "array", "map")}
    flat = df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns])
    flat.write.mode(mode).option("header", "true").option("quoteAll", "true").option("escape", '"').option("nullValue", None).csv(path)
