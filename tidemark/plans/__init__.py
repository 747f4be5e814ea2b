from .company_flags import CompanyPipeline
from .event_reports import EventPipeline, run_event_reports
from .item_growth import ItemGrowthPipeline

__all__ = ["CompanyPipeline", "EventPipeline", "run_event_reports", "ItemGrowthPipeline"]
