"""funnelkit: funnel analytics (cleaning, event pivot, sessions, step timing,
reports, data-quality checks, diagnostics, dashboard datasets) on Spark."""

__version__ = "0.1.0"
