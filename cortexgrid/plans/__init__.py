from cortexgrid.plans.cut import drop, materialize, scratch_root

__all__ = ["drop", "materialize", "scratch_root"]
