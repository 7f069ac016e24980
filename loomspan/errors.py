"""Errors a caller can observe."""


class LoomError(Exception):
    """Base of all errors of this engine."""


class ExpectedObject(LoomError):
    """A value that must be an object is something else."""


class ExpectedFieldPath(LoomError):
    """A write names a node but no field."""


class ArrayOfObjectsUnsupported(LoomError):
    """Arrays of objects can't be stored; use a set."""


class InvalidSetMember(LoomError):
    """A set member is neither an object nor a link."""


class InvalidMemberReference(LoomError):
    """A member reference isn't an id or a link."""


class TraversalIntoScalar(LoomError):
    """A path goes on behind a scalar."""


class TraversalIntoSet(LoomError):
    """A path goes on behind a set."""


class InvalidBinaryMarker(LoomError):
    """A bytes marker isn't base64."""


class InvalidBlobMarker(LoomError):
    """A blob marker lacks its id or size."""


class BlobNotFound(LoomError):
    """No blob has the id."""


class TransactionConflict(LoomError):
    """A precondition of a transaction or batch doesn't hold."""


class StrictScopeConflict(LoomError):
    """A transaction writes outside its scope, or an author lacks authority."""


class CapabilityDenied(LoomError):
    """A script asks for more than it was granted."""


class InvalidSpec(LoomError):
    """A specification has an unknown key, kind or value."""


class BlobStoreUnavailable(LoomError):
    """A blob is asked for and no store is open."""


class TooManyWatches(LoomError):
    """More watches than the limit."""


class StrictScopeUnavailable(LoomError):
    """A coordinated scope has no authority to decide."""


class MissingSharedFolder(LoomError):
    """A cluster's session names no folder that all executors share."""


class StaleIndex(LoomError):
    """A stored index doesn't match its source, and the policy refuses it."""
