from framewright.plans.operator import Abort, Operator
from framewright.plans.workspace import Workspace

__all__ = ["Abort", "Operator", "Workspace"]
